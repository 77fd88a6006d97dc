"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding undoes disguises: case, accents, letters of other scripts that look Latin, digits and signs in place of letters,
characters without width. A term is a whole word or the beginning of words; exception phrases hide the terms inside them.
A document's score is a logistic function of its terms' weights, in all and by length.

Terms, weights, exceptions and the logistic function are learned from labelled rows that aren't held out, at most about
``SAMPLE`` of them, chosen by a hash of their id. Scores see the text alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep, prepare, with_text

#: Labelled rows to learn from (expected number; the bound of what the driver and each worker hold).
SAMPLE = 20_000
#: Candidate terms that are counted among clean documents, the most frequent in toxic ones.
CANDIDATES = 50_000
#: Least evidence (log-likelihood ratio) for a term, terms that each toxic document may speak for, and terms in all.
EVIDENCE, SUPPORT, TERMS = 15.0, 3, 2000
#: Lengths of word beginnings that may be terms.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7

# Insults that count before anything is learned, and phrases in which such words are harmless.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
SEED_EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish")
SEED_WEIGHT = 3.0
# Characters that look like Latin letters, and those that stand for them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "ω": "w", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}


def folding() -> dict[int, str | None]:
    """What each character is folded to: lower case, the letter it looks like. Accented Latin letters stay apart, since
    they tell words of other languages from each other."""
    table: dict[int, str | None] = {}
    for code in [*range(0x20, 0x250), *range(0x370, 0x530), *range(0xFF01, 0xFF5F)]:
        char = chr(code).lower()
        if code >= 0x250:
            char = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        table[code] = "".join(LOOKALIKES.get(c, c) for c in char)
    table |= {code: None for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    return {code: char for code, char in table.items() if char is None or char != chr(code)}


FOLDING = folding()
#: Accented letters to plain ones: a word that is a term without its accents counts, too.
PLAIN = {code: plain for code in range(0xC0, 0x250) if (plain := "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))) != chr(code)}
_ACCENT = re.compile("[\u00c0-\u024f]")
_END = re.compile(r"[!|]+(?=[\s\"').,;:!?|]|$)")
_NUMBER = re.compile(r"(?<![^\W_])(?<![@$!|])\d[\d.,:/-]*(?![^\W_])")
_BREAK = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Words in folded letters, a space before and after each; '' without words."""
    text = _END.sub(" ", _NUMBER.sub(" ", text or ""))
    words = _BREAK.sub(" ", text.translate(FOLDING)).strip()
    return f" {words} " if words else ""


@dataclass
class Lexicon:
    """``terms`` maps ' word ' (a whole word) or ' begin' (the beginning of words) to its weight; ``exceptions`` are folded
    phrases with a space on both sides; ``logistic`` has the coefficients of the features."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    logistic: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (phrase, 0.0, True))
        for term, weight in self.terms.items():
            if term not in self.exceptions:
                self.automaton.add_word(term, (term, weight, False))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, folded: str) -> list[tuple[int, str]]:
        """(first letter's place, term) of every match outside exceptions."""
        if not len(self.automaton):
            return []
        out: list[tuple[int, str]] = []
        hidden: list[tuple[int, int]] = []
        for end, (term, _, exception) in self.automaton.iter(folded):
            start = end - len(term) + 2
            if exception:
                hidden.append((start, end))
            else:
                out.append((start, term))
        return [(s, t) for s, t in out if not any(a <= s < b for a, b in hidden)] if hidden else out

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(first letter's place, weight) of each word with a term, its heaviest, outside exceptions."""
        words: dict[int, float] = {}
        for start, term in self.found(folded):
            words[start] = max(self.terms[term], words.get(start, 0.0))
        return list(words.items())

    def accented(self, folded: str) -> float:
        """Weight of whole words that are terms only without their accents."""
        if not _ACCENT.search(folded):
            return 0.0
        found = 0.0
        for word in folded.split():
            if not word.isascii() and (plain := word.translate(PLAIN)).isascii():
                term = f" {plain} "
                found += self.terms.get(term, 0.0) if f" {word} " not in self.terms and term not in self.exceptions else 0.0
        return found

    def features(self, folded: str) -> tuple[float, float, float]:
        total = sum(w for _, w in self.matches(folded)) + self.accented(folded)
        return 1.0, min(total, 40.0), 10 * total / math.sqrt(folded.count(" ") + 25)

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.logistic, self.features(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(folded: str) -> set[str]:
    """Words and beginnings of words, as terms."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)
    return found


def evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio that a term in ``a`` toxic and ``b`` clean documents is more frequent in toxic ones; else 0."""
    if a * clean <= b * toxic:
        return 0.0
    total, g = toxic + clean, 0.0
    for seen, expected in ((a, (a + b) * toxic / total), (b, (a + b) * clean / total), (toxic - a, (total - a - b) * toxic / total), (clean - b, (total - a - b) * clean / total)):
        g += 2 * seen * math.log(seen / expected) if seen else 0.0
    return g


def weight(a: int, b: int, toxic: int, clean: int) -> float:
    return max(0.1, min(8.0, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))))


def choose(docs: list[list[int]], terms: list[str], clean_with: list[int], toxic: int, clean: int) -> list[int]:
    """Terms by greedy covering: the term with most evidence among documents that haven't spoken for ``SUPPORT`` terms yet,
    again and again. Copies of a document thus bring few terms of their own. Of terms that begin alike and that nearly the
    same documents hold, only the first counts."""
    holders: dict[int, set[int]] = {}
    for d, own in enumerate(docs):
        for t in own:
            holders.setdefault(t, set()).add(d)
    left = [SUPPORT] * len(docs)
    chosen: list[int] = []
    gain = {t: evidence(len(own), clean_with[t], toxic, clean) for t, own in holders.items()}
    while gain and len(chosen) < TERMS:
        # Of equal evidence the longest term, which other words are least likely to share.
        t = max(gain, key=lambda t: (gain[t], len(terms[t]), -t))
        own = holders[t]
        now = evidence(sum(1 for d in own if left[d]), clean_with[t], toxic, clean)
        if now < gain[t] - 1e-9 or now < EVIDENCE:
            gain[t] = now
            if now < EVIDENCE:
                del gain[t]
            continue
        chosen.append(t)
        for d in own:
            left[d] = max(0, left[d] - 1)
        for x in [x for x in gain if x == t or terms[x][:5] == terms[t][:5]]:
            if x == t or len(own & holders[x]) >= 0.8 * max(len(own), len(holders[x])):
                del gain[x]
    return chosen


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method with a small ridge, which keeps separable data finite."""
    w = np.zeros(features.shape[1])
    penalty = ridge * np.eye(features.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty, features.T @ (p - labels) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents that aren't held out; of several labels of a document the highest counts, and
    of several texts of one doc_id one is learned from."""
    spark = prepare(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~is_held_out(F.col("doc_id")))
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    # The hash of the id decides, so the choice is the same on every run and about ``sample`` rows large.
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # One text for each id, whatever the number of rows that share it: the one with the smallest hash.
    texts = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("one"))
    rows = keep(texts.select("one.text", "one.toxic"), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    seeds = {f" {t} ": SEED_WEIGHT for t in SEED_TERMS}
    exceptions = {f" {t} " for t in SEED_EXCEPTIONS}
    if not toxic or not clean:
        return Lexicon(seeds, exceptions)

    def counted(which: list[str] | None):
        wanted = None if which is None else frozenset(which)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column("text"):
                    own = candidates(fold(text.as_py()))
                    seen.update(own if wanted is None else own & wanted)
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        return count

    schema, least = "term string, n long", max(2, toxic // 500)
    often = rows.filter("toxic = 1").mapInArrow(counted(None), schema).groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    often = {r.term: r.n for r in often.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    among = rows.filter("toxic = 0").mapInArrow(counted(list(often)), schema).groupBy("term").agg(F.sum("n").alias("n"))
    among = {r.term: r.n for r in among.collect()}
    terms = sorted(t for t, a in often.items() if evidence(a, among.get(t, 0), toxic, clean) >= EVIDENCE)
    places = {t: k for k, t in enumerate(terms)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(places[t] for t in candidates(fold(x.as_py())) & places.keys()) for x in batch.column("text")]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int64()))], names=["terms"])

    holders = [r.terms for r in rows.filter("toxic = 1").mapInArrow(held, "terms array<long>").collect()]
    chosen = choose(sorted(holders), terms, [among.get(t, 0) for t in terms], toxic, clean)
    weights = {terms[t]: weight(often[terms[t]], among.get(terms[t], 0), toxic, clean) for t in chosen}
    seeds = {t: w for t, w in seeds.items() if t not in weights and among.get(t, 0) * toxic <= often.get(t, 0) * clean}
    lexicon = Lexicon(seeds | weights, exceptions)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text.as_py())
                own = set()
                for start in {s for s, _ in lexicon.found(folded)}:
                    first = folded.find(" ", start)
                    first = len(folded) if first < 0 else first
                    second = folded.find(" ", first + 1)
                    two = folded[start : len(folded) if second < 0 else second].strip()
                    before = folded[folded.rfind(" ", 0, max(0, start - 1)) + 1 : max(0, start - 1)]
                    own.update({f" {folded[start:first]} ", f" {before} {folded[start:first]} ", f" {two} "})
                seen.update((phrase, label) for phrase in own)
        keys = list(seen)
        yield pa.record_batch([pa.array([p for p, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    # A phrase around terms that clean documents use, and relatively more often than toxic ones, excuses them.
    around = rows.mapInArrow(contexts, "phrase string, toxic long, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    around = around.filter((F.col("clean") >= max(3, clean // 5000)) & (F.col("clean") * toxic > F.col("toxic") * clean))
    learned = {r.phrase for r in around.orderBy(F.desc("clean"), "phrase").limit(TERMS).collect()}
    lexicon = Lexicon(seeds | weights, exceptions | learned)

    def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                seen.update((t, label) for t in {t for _, t in lexicon.found(fold(text.as_py()))})
        keys = list(seen)
        yield pa.record_batch([pa.array([p for p, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    # Weights count what exceptions leave.
    again = {(r.phrase, r.toxic): r.n for r in rows.mapInArrow(recounted, "phrase string, toxic long, n long").groupBy("phrase", "toxic").agg(F.sum("n").alias("n")).collect()}
    weights = {t: weight(again.get((t, 1), 0), again.get((t, 0), 0), toxic, clean) for t in weights}
    lexicon = Lexicon(seeds | weights, lexicon.exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(fold(x.as_py())) for x in batch.column("text")]
            yield pa.record_batch([pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), batch.column("toxic").cast(pa.float64())], names=["a", "b", "y"])

    points = np.array(sorted(map(tuple, rows.mapInArrow(measured, "a double, b double, y double").collect())))
    return Lexicon(lexicon.terms, lexicon.exceptions, logistic(np.column_stack([np.ones(len(points)), points[:, :2]]), points[:, 2]))


def scored(docs: DataFrame, lexicon: Lexicon, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every document (default: all) and ``_score``; a null text is scored as an empty one."""
    prepare(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    # A carried text that is a string is scored where it is; others get a column that goes to the tasks only.
    text = "text" if "text" in carry and docs.schema["text"].dataType == T.StringType() else "_text"
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], *([F.col("text").cast("string").alias("_text")] if text == "_text" else []))
    schema = T.StructType([*rows.schema.fields[: len(carry)], T.StructField("_score", T.DoubleType())])
    made = (lexicon.terms, lexicon.exceptions, lexicon.logistic)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*made)
        for batch in batches:
            found = pa.array([own.score(t.as_py()) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], found], names=schema.names)

    return rows.mapInArrow(score, schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    found = scored(docs, learn(docs, labels, **options), ["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't found toxic, with the columns of ``docs``, whatever their names.

    A null text is scored as an empty one; equal rows stay or go together; an empty table stays empty, and without labels
    the lexicon is the fixed one.
    """
    rows, own, restored = with_text(docs)
    return restored(scored(rows, learn(docs, labels, **options), own).filter(F.col("_score") < THRESHOLD))

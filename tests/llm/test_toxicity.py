import random
import zlib

import pytest
from pyspark.sql import Row

from folioflow.llm import toxicity
from folioflow.llm.queries import op3_toxicity


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        (None, ""), ("", ""), (" 12 3.5 ", ""), ("You IDIOT!!", " you idiot "), ("1d10t", " idiot "), ("іdіоt", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("$tup1d", " stupid "), ("i​diot", " idiot "),
        ("on 108.51.216.133 at 4", " on at "), ("été ÉTÉ", " été été "), ("a!b", " aib "), ("what?! no!", " what no "), ("abc123", " abci e "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def plain_matches(lexicon, folded):
    """Every term at every word, without an automaton."""
    words, out, at = folded.split(), [], 1
    hidden = [(i + 1, i + len(p) - 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    for word in words:
        own = [w for t, w in lexicon.terms.items() if t not in lexicon.exceptions and (t == f" {word} " or (not t.endswith(" ") and word.startswith(t[1:])))]
        if own and not any(a <= at < b for a, b in hidden):
            out.append((at, max(own)))
        at += len(word) + 1
    return out


def test_matches_by_every_term():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idio": 2.0, " scum ": 1.5, " trash ": 1.0, " sc": 0.5}, {" trash can ", " scum of "})
    rng = random.Random(6)
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(["idiot", "idiots", "scum", "of", "trash", "can", "score", "a", "xidiot"]) for _ in range(rng.randint(0, 12))))
        assert sorted(lexicon.matches(folded)) == sorted(plain_matches(lexicon, folded))


def corpus(n=900, seed=3):
    """Two languages; toxic documents hold disguised words or words with a stem; a harmless word shares the stem."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(["ba", "ne", "lo", "ti", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["grubwort", "Grubw0rt", "zunkel" + rng.choice(["ba", "ne", "lo"]), "grubwоrt"]))
        elif k % 7 == 0:
            words.insert(rng.randint(0, len(words)), "zunkelhaft")
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_learned_terms_find_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([Row(doc_id=i, text=t, toxic=9, _score=1) for i, t, _ in rows])
    labels = spark.createDataFrame([Row(doc_id=i, quality=1, toxic=y) for i, _, y in rows])
    found = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    for i, _, y in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert (found[i].predicted == 1) == (found[i].score >= 0.7) and 0 <= found[i].score <= 1
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    lexicon = toxicity.learn(docs, labels)
    assert not lexicon.score("ne lo zunkelhaft ba") > 0.5 and lexicon.score("ne lo zunkellora ba") > 0.7 and lexicon.score("ba GRUBW0RT!") > 0.7


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    told = [(i, y) for i, _, y in rows]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in told]
    lexicons = [toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (told, turned)]
    assert lexicons[0] == lexicons[1]


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "idiot " * 50_000), (3, "idiot " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    found = sorted(((r.doc_id or 0, r.predicted) for r in toxicity.report(docs, labels).collect()))
    assert found == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert toxicity.report(docs.limit(0), labels.limit(0)).collect() == []
    assert toxicity.clean_documents(docs, labels.limit(0)).columns == docs.columns


def test_texts_are_read_in_small_batches(spark):
    """The heap holds a batch of Parquet rows in one array, whatever their length."""
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    assert toxicity.report(docs, docs.selectExpr("doc_id", "0 toxic").limit(0)).count() == 2
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_query(spark, sf_dir):
    """Every score by the learned lexicon, one text at a time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, texts = toxicity.learn(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    found = op3_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.score == lexicon.score(texts[r.doc_id]) for r in found)


def test_stage_keeps_columns_of_any_name(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, 9, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, _score int, _text string, `a.b` double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert 0 < kept.filter("_score = 9 and _text = 's' and `a.b` = 0.5").count() == kept.count() < 300
    assert toxicity.clean_documents(docs.limit(0), labels.limit(0)).collect() == []


def test_one_text_of_an_id_is_learned_from(spark):
    """An id that many rows share brings one of them."""
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, f"copy {k}") for k in range(500)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.keep
    try:
        toxicity.keep = lambda df, name: seen.append(real(df, name)) or seen[-1]
        toxicity.learn(docs, labels)
    finally:
        toxicity.keep = real
    ids = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert seen[0].count() == len(ids)

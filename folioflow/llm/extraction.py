"""Main text of HTML pages: a conditional random field labels the leaf blocks of the DOM, Viterbi decodes them.

Features are the enclosing elements and their names, and what the text is like. The field is trained on ``PAGES`` labelled
pages of many layouts, drawn from a seed, on the driver: a bounded amount that doesn't depend on the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Chain, fit
from .dom import Block, Element, blocks
from .pages import Writer
from .store import prepare

#: Labelled pages to train on, and the seed they are drawn from.
PAGES, SEED = 900, 20
#: Elements that say nothing about what is in them.
PLAIN = frozenset("html body div p span li ul ol table tbody tr td section center".split())

_MARK = re.compile(r" ?q\d+q\b")
_PHRASE = re.compile(r"cookie|newsletter|subscrib|sign (?:in|up)|log ?in|javascript|privacy|advert|sponsor|read more|share|comment|repl(?:y|ies)|follow us|terms of", re.I)
_RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)
_SENTENCE = re.compile(r"[.!?…\"»)]$")


@dataclass
class Around:
    """What the elements around a block say; each element's is its parent's and what it adds itself."""

    tags: frozenset[str]
    path: int  # the same for the same tags in the same order
    near: tuple[str, ...] = ()
    inner: str = "none"
    score: tuple[float, float] = (0.0, 0.0)


class Surroundings:
    """``Around`` of the elements of a page, each worked out once: time and memory follow the elements, not their depth."""

    def __init__(self, chain: Chain | None = None):
        self.chain, self.known, self.paths = chain, {}, {}
        self.nothing = Around(frozenset(), 0)

    def of(self, element: Element | None) -> Around:
        new = []
        while element is not None and element not in self.known:
            new.append(element)
            element = element.parent
        around = self.nothing if element is None else self.known[element]
        for element in reversed(new):
            around = self.known[element] = self.inside(around, element)
        return around

    def inside(self, around: Around, element: Element) -> Around:
        tag, names = element.tag, element.names
        path = self.paths.setdefault((around.path, tag), len(self.paths) + 1)
        # The innermost enclosing element that says something, by its name or its kind, outweighs those around it.
        near = tuple(f"near:{n}" for n in names) or ((f"near:<{tag}>",) if tag not in PLAIN else around.near)
        inner = tag if tag not in PLAIN and not tag.startswith("h") else around.inner
        score = around.score
        if self.chain is not None:
            own = self.chain.score([f"named:{n}" for n in names] + ([] if tag in around.tags else [f"in:{tag}"]))
            score = (score[0] + own[0], score[1] + own[1])
        return Around(around.tags if tag in around.tags else around.tags | {tag}, path, near, inner, score)


def own_features(page: list[Block], place: int, surroundings: Surroundings) -> list[str]:
    """The features of a block but for the kinds and names of all elements around it."""
    block, own = page[place], ["any"]
    if block.element is not None:
        around = surroundings.of(block.element)
        own += [f"tag:{block.element.tag}", *around.near, f"inner:{around.inner}"]
    n = block.text.count(" ") + 1
    own.append("words:" + ("1" if n < 3 else "3" if n < 6 else "6" if n < 11 else "11" if n < 26 else "26" if n < 61 else "61"))
    own.append("link:" + ("no" if not block.link else "some" if block.link < 0.5 else "most" if block.link < 0.95 else "all"))
    own.append("ends" if _SENTENCE.search(block.text) else "open")
    if n < 40 and _PHRASE.search(block.text):
        own.append("phrase")
    if _RIGHTS.search(block.text[:300]):
        own.append("rights")
    if " | " in block.text or " · " in block.text:
        own.append("bars")
    if place == 0:
        own.append("first")
    if place == len(page) - 1:
        own.append("last")
    if place and _parent(page[place], surroundings) == _parent(page[place - 1], surroundings):
        own.append("same parent")
    return own


def _parent(block: Block, surroundings: Surroundings) -> int:
    return surroundings.of(block.element.parent).path if block.element is not None else 0


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    surroundings = Surroundings()
    return [
        own_features(page, k, surroundings) + [f"in:{t}" for t in sorted(set(block.tags))] + [f"named:{n}" for names in block.names for n in names]
        for k, block in enumerate(page)
    ]


def label(chain: Chain, page: list[Block]) -> list[int]:
    """The label of each block of a page: those of its ``features``, whose lists aren't made."""
    surroundings, scores = Surroundings(chain), []
    for k, block in enumerate(page):
        own, around = chain.score(own_features(page, k, surroundings)), surroundings.of(block.element).score
        scores.append([own[0] + around[0], own[1] + around[1]])
    return chain.best(scores)


def train(pages: int = PAGES, seed: int = SEED) -> Chain:
    writer, labelled = Writer(seed), []
    for _ in range(pages):
        source, labels = writer.page()
        found = blocks(source)
        known = []
        for block in found:
            marks = _MARK.findall(block.text)
            known.append(max((labels.get(m.strip(), 0) for m in marks), default=0))
            block.text = _MARK.sub("", block.text) or "x"
        # A cut in the last mark leaves its block without a label; such a block is left out.
        whole = [k for k, b in enumerate(found) if k < len(found) - 1 or source.endswith("</html>")]
        labelled.append(([f for k, f in enumerate(features(found)) if k in set(whole)], [known[k] for k in whole]))
    return fit(labelled)


def main_text(chain: Chain, page: str | None) -> str:
    """The blocks of the article, one to a line."""
    found = blocks(page)
    return "\n".join(b.text for b, kept in zip(found, label(chain, found), strict=True) if kept)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text) of every page; a null or empty page has an empty text. Rows are neither dropped nor merged."""
    prepare(pages.sparkSession)
    chain = chain or train()
    made = (chain.index, chain.weights, chain.moves, chain.starts)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*made)
        for batch in batches:
            texts = pa.array([main_text(own, t.as_py()) for t in batch.column("text")], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return rows.mapInArrow(read, rows.schema)


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))

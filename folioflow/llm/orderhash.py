"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text (runs of ``K`` code points) are numbered by occurrence, so repeats differ. For each of ``SKETCHES``
hash orders the ``L`` smallest numbered k-mers are taken, put back into text order, and hashed as a tuple. Two texts agree
in a sketch if they share these k-mers in the same order; the share of equal sketches is their likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import shard_of, shards
from .store import prepare
from .texts import mixed, polynomial

K, L, SKETCHES = 8, 2, 64
DOCS_PER_TASK = 4096
GOLDEN = 0x9E3779B97F4A7C15
ORDERS = mixed(np.arange(1, 1025, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
#: k-mers that are hashed under all orders at a time.
WIDE = 4096


def numbered(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-mer with its number among equal ones before it; a shorter text is one k-mer, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    h = mixed(polynomial(codes + np.uint32(1), k, GOLDEN) + np.uint64(k))
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(np.diff(h[order]) != 0) + 1
    first = np.zeros(len(h), np.int64)
    first[same] = same
    number = np.empty(len(h), np.uint64)
    number[order] = (np.arange(len(h)) - np.maximum.accumulate(first)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(h + number * np.uint64(GOLDEN))


def smallest(h: np.ndarray, sketches: int, length: int) -> np.ndarray:
    """Places of the ``length`` smallest k-mers under each order, in text order."""
    found, places = [], []
    row = np.arange(sketches)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), WIDE):
            v = h[a : a + WIDE] * ORDERS[:sketches, None]
            for _ in range(min(length, v.shape[1])):
                at = v.argmin(axis=1)
                found.append(v[row, at])
                places.append(at + a)
                v[row, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    value, place = np.stack(found, axis=1), np.stack(places, axis=1)
    best = np.argsort(value, axis=1, kind="stable")[:, :length]
    return np.sort(np.take_along_axis(place, best, axis=1), axis=1)


def sketch(text: str, k: int = K, length: int = L, sketches: int = SKETCHES) -> np.ndarray:
    """32 bits of each tuple's hash; an empty text has tuples of nothing."""
    h = numbered(text, k)
    out = np.arange(1, sketches + 1, dtype=np.uint64)
    if len(h):
        with np.errstate(over="ignore"):
            for place in smallest(h, sketches, length).T:
                out = mixed(out * np.uint64(GOLDEN) + h[place])
    return (out >> np.uint64(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


FOUND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, rows_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """Every document with the fingerprints of its text and its edited text, and its likeness to that and to the next text.

    The next document is that in descending doc_id order, after the last the first; rows of one doc_id are ordered by
    their text, and null doc_ids come last. A null text is empty. A document alone is its own next. Tasks get runs of
    documents in that order; the first document of a run goes to the task before as well, and tasks read as a stream.
    """
    prepare(docs.sparkSession)
    cuts = shards(docs, "doc_id", rows_per_task)
    n = max(1, len(cuts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), cuts))
    own = F.struct(F.col("shard").alias("task"), F.lit(0).alias("after"))
    if cuts:
        # Ascending shards, read downwards: the highest document of a shard follows the lowest of the next shard.
        highest = F.get(F.lit([b for _, b in cuts]), F.col("shard")) == F.col("doc_id")
        ahead = F.struct(F.pmod(F.col("shard") + 1, F.lit(n)).cast("int").alias("task"), F.lit(1).alias("after"))
        rows = rows.withColumn("to", F.explode(F.when(highest, F.array(own, ahead)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("to", own)
    rows = rows.select("to.task", "to.after", "doc_id", "text").repartitionById(n, "task")
    rows = rows.sortWithinPartitions("task", "after", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_follow, schema)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    held: list[dict] = []
    size, ended = 0, False

    def pair(row: tuple, after: tuple) -> dict:
        doc_id, text, own = row
        new = edited(text, after[1])
        new_sketch = sketch(new)
        return {"doc_id": doc_id, "n_chars": len(text), "edited_text": new, "fingerprint": own.tobytes().hex(), "edited_fingerprint": new_sketch.tobytes().hex(), "near_edited": likeness(own, new_sketch), "near_next": likeness(own, after[2])}

    for batch in batches:
        for after, doc_id, text in zip(batch.column("after").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if ended:
                break
            ended = after == 1
            text = text.as_py()
            now = (doc_id, text, sketch(text))
            if last is not None:
                held.append(pair(last, now))
                size += len(text)
            elif ended:
                break
            first, last = first or now, None if ended else now
            if len(held) >= 500 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, FOUND)
                held, size = [], 0
    if last is not None:
        held.append(pair(last, first))
    yield pa.RecordBatch.from_pylist(held, FOUND)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = fingerprints(docs)
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")

"""Hard negatives: for each anchor and positive, the rows of other labels that score just below the positive.

The upper limits of an anchor's windows are the scores of its positives. They split all scores into slots that don't
overlap. A task holds a block of rows and reads the anchors as a stream of files; of each slot of an anchor it keeps the
first few rows. The blocks' rows are combined slot by slot, and a merge of the slots from the lowest up gives for every
positive the first rows at or below its score, whatever windows overlap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, opened, prepare

#: Numbers that a block of rows has at most (a row at least), and scores that are worked on at a time.
BLOCK, TILE = 4_000_000, 4_000_000
SCALE = 256
#: Products below it are exact in doubles.
EXACT = 2.0**53


def vectors(rows: DataFrame, new_label: Callable[[Column, Column], Column]) -> DataFrame:
    """(row, vec_id, label, v): rows that take part, with whole-number components."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(whole)
    # floor() of a double is a long, which has an end; rounding down by rint() keeps large components as they are.
    scaled = F.transform(v, lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", new_label(F.col("vec_id"), F.col("label")).alias("label"), scaled.alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where they can't be rounded, else Python's whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(a), whole(b.T))


def firsts(scores: np.ndarray, groups: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: by falling score, then by order."""
    if scores.dtype == object:
        sorted_ = np.array(sorted(range(len(scores)), key=lambda x: (groups[x], -scores[x], order[x])), dtype=np.int64)
    else:
        sorted_ = np.lexsort((order, -scores, groups))
    if not len(sorted_):
        return sorted_
    of = groups[sorted_]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return sorted_[place < k]


class Block:
    """Rows of one length, ordered by vec_id."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray):
        by = np.lexsort((row, vec_id))
        self.row, self.vec_id, self.label, self.v = row[by], vec_id[by], label[by], v[by]


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch by the length of its vectors; vectors of other lengths aren't compared."""
    sizes = np.diff(batch.column("v").offsets.to_numpy(zero_copy_only=False))
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """The rows of a task as blocks of bounded size."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def block(size: int) -> Block:
        t = pa.Table.from_batches(held.pop(size)).combine_chunks()
        row, vec_id, label = (t.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        return Block(row, vec_id, label, matrix(t.column("v").combine_chunks(), size))

    for batch in batches:
        for size, part in grouped(batch):
            held.setdefault(size, []).append(part)
            if sum(p.num_rows for p in held[size]) * max(size, 8) >= BLOCK:
                yield size, block(size)
    for size in list(held):
        yield size, block(size)


def anchors_in(files: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """Anchors from the shared folder, ``n`` at a time."""
    for uri in files:
        store, path = opened(uri)
        with store.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(n)


def files_of(table: DataFrame) -> list[str]:
    return sorted(table.inputFiles())


FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])
_FOUND = "anchor long, slot int, score long, vec_id long, row long"
#: Scores outside of a long are shown as its end.
_ENDS = (-(2**63), 2**63 - 1)


def _record(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, block: Block, at: np.ndarray) -> pa.RecordBatch:
    if score.dtype == object:
        score = np.array([min(max(x, _ENDS[0]), _ENDS[1]) for x in score], dtype=np.int64)
    return pa.record_batch([anchor, slot.astype(np.int32), score.astype(np.int64), block.vec_id[at], block.row[at]], schema=FOUND)


def _tiles(files: list[str], size: int, block: Block) -> Iterator[pa.RecordBatch]:
    for batch in anchors_in(files, max(1, min(1024, TILE // max(len(block.row), 1)))):
        for n, part in grouped(batch):
            if n == size:
                yield part


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, score, vec_id, row, rank): the first k other rows of each anchor's label."""
    files = files_of(anchors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, block in blocks(batches):
            by = np.argsort(block.label, kind="stable")  # by label, and by vec_id within
            labels = block.label[by]
            for part in _tiles(files, size, block):
                names, own, v = part.column("row").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), size)
                for label in np.unique(own).tolist():
                    at = by[np.searchsorted(labels, label) : np.searchsorted(labels, label, "right")]
                    asked = np.flatnonzero(own == label)
                    if not len(at):
                        continue
                    scores = products(v[asked], block.v[at])
                    a, b = np.nonzero(names[asked][:, None] != block.row[at][None, :])
                    if len(at) > 4 * k and scores.dtype != object:  # only those that can be among the first
                        least = np.partition(scores, len(at) - k - 1, axis=1)[:, len(at) - k - 1]
                        a, b = np.nonzero((scores >= least[:, None]) & (names[asked][:, None] != block.row[at][None, :]))
                    score = scores[a, b]
                    best = firsts(score, a, b, k)
                    yield _record(names[asked][a[best]], np.zeros(len(best)), score[best], block, at[b[best]])

    found = rows.select("row", "vec_id", "label", "v").mapInArrow(search, _FOUND).drop("slot")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def slotted(rows: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, score, vec_id, row): the first k rows of other labels in each slot of an anchor.

    ``limits`` are an anchor's upper limits, falling; slot j holds the scores up to limit j and above limit j + 1. What is
    below every window that begins at a higher limit isn't kept.
    """
    files = files_of(anchors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, block in blocks(batches):
            for part in _tiles(files, size, block):
                names, own, v = part.column("row").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), size)
                limits = part.column("limits").to_pylist()
                scores = products(v, block.v)
                top = np.array([x[0] for x in limits], dtype=scores.dtype if scores.dtype == object else np.float64)
                least = np.array([-(-low * x[-1] // high) for x in limits], dtype=top.dtype)  # of the lowest window
                a, b = np.nonzero((scores <= top[:, None]) & (scores >= least[:, None]) & (own[:, None] != block.label[None, :]))
                score, slot = scores[a, b], np.zeros(len(a), np.int64)
                for j in range(1, max((len(x) for x in limits), default=1)):
                    edge = np.array([x[j] if j < len(x) else _ENDS[0] for x in limits], dtype=top.dtype)
                    slot += (score <= edge[a]).astype(np.int64)
                best = firsts(score, a * 64 + slot, b, k)
                yield _record(names[a[best]], slot[best], score[best], block, b[best])

    found = rows.select("row", "vec_id", "label", "v").mapInArrow(search, _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def suffix_merges(found: DataFrame, k: int, slots: int) -> DataFrame:
    """(anchor, tops): for each slot, the first k rows at or below its limit. Slots fall, so a merge is a concatenation."""
    each = F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "vec_id", "row", "score")))
    lists = found.groupBy("anchor").agg(each.alias("all"))
    # An anchor has at most ``slots`` slots of k rows.
    tops = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: F.slice(F.filter("all", lambda x: x["slot"] >= j), 1, k))
    return lists.select("anchor", tops.alias("tops"))


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], new_label: Callable[[Column, Column], Column] = lambda i, label: label, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``n_positives`` other rows of the same label, by whole-number inner product and
    then by vec_id; a positive's negatives the first ``n_negatives`` rows of other labels with
    ``low * positive_score <= high * negative_score <= high * positive_score``. Rows without vec_id, label or vector, or
    with a component that is null or not finite, take no part. Vectors of different lengths aren't compared. Rows of one
    vec_id are rows of their own: each anchor among them is asked for, and ties go by row. An anchor without positives
    or negatives has no rows in the result; an empty table has none. Columns beyond vec_id, embedding and label aren't
    read.
    """
    if n_positives > 64:
        raise ValueError("at most 64 positives")
    spark = prepare(rows.sparkSession)
    rows = keep(vectors(rows, new_label), "vectors")
    size = rows.agg(F.sum(F.greatest(F.size("v"), F.lit(8)))).first()[0] or 0
    n = max(math.ceil(size / BLOCK), min(math.ceil(16 * size / BLOCK), 2 * spark.sparkContext.defaultParallelism))
    spread = keep(rows.repartition(max(n, 1)), "blocks")
    anchors = keep(rows.filter(is_anchor(F.col("vec_id"))), "anchors")
    first = keep(positives(spread, anchors, n_positives), "positives")
    limits = first.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    asked = keep(anchors.join(limits.withColumnRenamed("anchor", "row"), "row"), "asked")
    found = keep(slotted(spread, asked, n_negatives, low, high), "slots")
    tops = suffix_merges(found, n_negatives, n_positives)
    slot = (F.array_position("limits", F.col("score")) - 1).cast("int")
    pairs = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "limits")
    pairs = pairs.join(first, "anchor").select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), "rank", F.col("score").alias("positive_score"), slot.alias("slot"))
    pairs = pairs.withColumnRenamed("rank", "positive_rank").join(tops, "anchor")
    window = F.filter(F.get("tops", F.col("slot")), lambda x: F.lit(low) * F.col("positive_score").cast("decimal(20,0)") <= F.lit(high) * x["score"].cast("decimal(20,0)"))
    out = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("place", "x"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def report(rows: DataFrame) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 100; where it is divisible by 7, the label first moves on by one."""
    return mine(rows, lambda i: F.pmod(i, F.lit(100)) == 0, lambda i, label: F.when(F.pmod(i, F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label))

"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments. If two fingerprints differ in at most 4 bits, one segment differs in
at most 2, and then some value is within one bit of both segments' values. So each fingerprint is entered in a table under
every value of the Hamming ball of radius 1 around each of its segments (66 entries), entries that meet are candidates,
and the whole distance decides.

Equal fingerprints are merged first. Entries that meet in a small group are compared in one task. A group with more
fingerprints than ``HOT`` isn't: its fingerprints are entered again under every 64-bit value within 2 bits of them. Two
fingerprints at 4 bits or fewer share such a value, and any two that share one are at 4 bits or fewer, so these groups
need no comparison at all, and the work for a hot group is in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep, prepare

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints of a table entry that one task compares with each other.
HOT = 1024
#: Table entries that one task makes, about: Spark counts them in its memory, some 100 bytes each.
ENTRIES = 1 << 20

#: Flips of at most one bit in either half, and of at most two bits anywhere.
BALL_1 = np.array([0, *(1 << b for b in range(32))], np.uint64)
BALL_2 = np.array([0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(first, last, strict=True)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 4096):
        counts += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of ``also``, print) of every row; a null text has no words."""
    rows = docs.select("doc_id", *also, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("print", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield batch.drop_columns("text").append_column("print", pa.array(found.view(np.int64)))

    return rows.mapInArrow(measure, schema)


def ball_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, value, print) for the ball of radius 1 around both halves of a fingerprint."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            p = batch.column("print").slice(a, 4096).to_numpy().view(np.uint64)
            for half in (0, 1):
                value = ((p >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))[:, None] ^ BALL_1
                key = (value.ravel() << np.uint64(1)) | np.uint64(half)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(p, len(BALL_1)).view(np.int64))], names=["entry", "print"])


def wide_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, print) for every 64-bit value within two bits of a fingerprint."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            p = batch.column("print").slice(a, 256).to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array((p[:, None] ^ BALL_2).ravel().view(np.int64)), pa.array(np.repeat(p, len(BALL_2)).view(np.int64))], names=["entry", "print"])


def entered(prints: DataFrame, entries: Callable, each: int, most: int = ENTRIES) -> DataFrame:
    """(entry, print) of a written table of distinct fingerprints, which have ``each`` entries; a task makes about ``most``.

    The table is small beside its entries, so files of it can't be what tasks are cut by."""
    tasks = max(1, -(-prints.count() * each // most))
    return prints.repartition(tasks, "print").mapInArrow(entries, "entry long, print long")


def spanning(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of at most ``bits`` bits that join all fingerprints that such links connect within the group: a forest."""
    own, out = prints.view(np.uint64), []
    left = np.ones(len(own), bool)
    for root in range(len(own)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(own ^ own[k]) <= bits))
            left[near] = False
            out += [(int(prints[k]), int(prints[x])) for x in near]
            queue += near.tolist()
    return out


def compare(batches: Iterator[pa.RecordBatch], bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Links within each group of candidates."""
    for batch in batches:
        found = [link for row in batch.column("prints") for link in spanning(row.values.to_numpy(), bits)]
        a = np.array(found, np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(a.min(axis=1) if len(a) else a[:, 0]), pa.array(a.max(axis=1) if len(a) else a[:, 0])], names=["a", "b"])


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) links between distinct fingerprints that connect just what all links of at most 4 bits connect."""
    entries = entered(prints, ball_entries, 2 * len(BALL_1))
    sizes = entries.groupBy("entry").agg(F.count("*").alias("n"))
    shared = keep(sizes.filter("n > 1"), "entries")
    # Both sides grow with the corpus, so the plan is the same at every size.
    met = entries.join(shared.hint("merge"), "entry")
    groups = met.filter(F.col("n") <= hot).groupBy("entry").agg(F.collect_list("print").alias("prints"))
    # Most groups are the same few fingerprints under another value: each set is compared once.
    small = groups.select(F.array_sort("prints").alias("prints")).distinct().mapInArrow(compare, "a long, b long")
    crowded = keep(met.filter(F.col("n") > hot).select("print").distinct(), "crowded")
    wide = entered(crowded, wide_entries, len(BALL_2))
    heads = wide.groupBy("entry").agg(F.min("print").alias("a"), F.max("print").alias("z")).filter("a < z")
    large = wide.join(heads.select("entry", "a"), "entry").filter("a < print").select("a", F.col("print").alias("b"))
    return keep(small.union(large).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is reachable from each node of some edge.

    Alternating large-star and small-star steps; each is a grouping by node, and all but a few rounds shrink the graph.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, before = keep(edges, "star"), None
    while True:
        # Large star: larger neighbours move to a node's smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join below is one of two plain exchanges, which Spark splits at a hot node.
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u")
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = keep(edges, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def grouped(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of ``also``, print, root, component_id) of every row; each component has a ``root`` of its own, also
    where components share a component_id or have none."""
    prepare(docs.sparkSession)
    rows = keep(fingerprints(docs, shingle, also), "prints")
    distinct = keep(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("print"), hot))
    labelled = keep(distinct.join(roots, distinct.print == roots.node, "left").select("print", "first", F.coalesce("root", "print").alias("root")), "roots")
    heads = keep(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    names = keep(labelled.join(heads, "root").select("print", "root", "component_id"), "names")
    return rows.join(names, "print").select("doc_id", *also, "print", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(doc_id, print, component_id) of every row; a component's id is the smallest doc_id that links reach.

    Null texts and texts without words have fingerprint 0 and link like any other. Rows of one doc_id stay rows; a null
    doc_id is the smallest of a component only if there is no other. An empty table gives an empty one.
    """
    return grouped(docs, shingle, hot).select("doc_id", "print", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, fingerprint in 16 hex digits, component_id."""
    found = near_duplicates(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row of each component, with the columns of ``docs``.

    It is that with the smallest doc_id, null last; of several such rows that with the smallest text, then the smallest
    other columns. Rows are told apart by a number that is written with them, so components that share a doc_id or have
    none keep a row each.
    """
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    lead = grouped(rows, also=("_row",), **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    lead = keep(lead.select("root", "_row"), "lead")
    # Written, so that Spark knows how few roots have several such rows: only their texts are compared.
    least = keep(lead.groupBy("root").agg(F.count("*").alias("n"), F.min("_row").alias("_row")), "least")
    tied = keep(lead.join(least.filter("n > 1").select("root"), "root"), "tied")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.to_json(F.struct(*own)).alias("rest")
    texts = rows.select("_row", F.col("text").cast("string").alias("text"), rest).join(tied, "_row")
    first = texts.groupBy("root").agg(F.min(F.struct("text", "rest", "_row")).alias("first")).select("first._row")
    kept = least.filter("n = 1").select("_row").union(first)
    return rows.join(kept, "_row", "left_semi").select(*own)

"""Merkle manifest of a table: a tree of hashes per source, a tree over the sources, and every row's witness.

Rows are numbered in the order of their source without a window over it. Runs of rows that are aligned to whole subtrees
(blocks) go to tasks. A task appends a block's leaves one after another to its open subtrees; when a run of siblings is
complete, each of them gets the others as the next part of the witness of all that is below it. The roots of the blocks
are appended to a next tree in the same way, until a source has one, and the sources' roots to the last tree. The parts
of the witnesses that upper trees add then travel down, once per block, and complete the leaves' own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, prepare

FAN = 16
#: A block has up to FAN ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task hands on at a time.
BATCH = 4096


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """Hash of a row's fields: each is '-' if null, else its length in UTF-8 bytes, a colon and its text."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Subtree:
    """Open subtrees of a growing tree, and the witnesses of what was appended so far.

    ``parts[level][k]`` are the siblings of node k of a level, joined left to right: the part of the witness that all
    below that node share. A node of an open run has none yet; it gets it when the run is closed.
    """

    def __init__(self) -> None:
        self.open: list[list[str]] = [[]]
        self.parts: list[list[str]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.parts.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.parts[level] += ["".join(run[:k] + run[k + 1 :]) for k in range(len(run))]
        self.append(hashed("".join(run)), level + 1)

    def finish(self, levels: int) -> str:
        """Close what is open below a level, and return the root there."""
        for level in range(levels):
            if self.open[level]:
                self.close(level)
        return self.open[levels][0]

    def witness(self, k: int, levels: int) -> tuple[list[str], list[int]]:
        """Siblings of leaf k by level, and its places among them."""
        ups = [k // FAN**level for level in range(levels)]
        return [self.parts[level][up] for level, up in enumerate(ups)], [up % FAN for up in ups]


def folded(node: str, siblings: list[str], places: list[int]) -> str:
    """The root that a node and its witness give."""
    for some, k in zip(siblings, places, strict=True):
        node = hashed(some[: 64 * k] + node + some[64 * k :])
    return node


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``pos``, their place in their group by some columns, and ``n``, the size of the group.

    Whole rows are sorted into ranges; a range knows its first places once the ranges' counts are added up.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = keep(ranged.withColumn("id", F.monotonically_increasing_id()), "ranges")
    parts = ranged.groupBy(F.col(group).alias("counted"), F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    within = Window.partitionBy("counted")
    before = F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = keep(parts.select("counted", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(within).alias("n")), "places")
    same = F.col(group).eqNullSafe(F.col("counted")) & (F.shiftright("id", 33) == F.col("part"))
    return ranged.join(parts, same).withColumn("pos", F.col("id") + F.col("shift")).drop("counted", "part", "shift", "id")


def levels_of(n: Column) -> Column:
    """Levels that a block of a group of n nodes has: all if the group has several blocks, else as many as n needs."""
    needed = F.lit(0)
    for level in range(BLOCK_LEVELS):
        needed = needed + (n > FAN**level).cast("int")
    return needed


def blocks(nodes: DataFrame, *more: DataFrame) -> DataFrame:
    """Nodes (grp, pos, n, node, ...) by block, in order; ``more`` rows join their blocks' tasks, ahead by their pos."""
    size = FAN**BLOCK_LEVELS
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("levels", levels_of(F.col("n")))
    for rows in more:
        nodes = nodes.unionByName(rows, allowMissingColumns=True)
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after another; they come in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["grp"], row["block"]) != (held[0]["grp"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


ROOT = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("node", pa.string())])
WITNESS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("siblings", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])


def _grown(rows: list[dict]) -> tuple[Subtree, str, int]:
    tree, levels = Subtree(), rows[0]["levels"]
    for row in rows:
        tree.append(row["node"])
    return tree, tree.finish(levels), levels


def roots(nodes: DataFrame) -> DataFrame:
    """(grp, pos, n, node): the roots of the blocks of (grp, pos, n, node), numbered by their blocks."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(({"grp": rows[0]["grp"], "pos": rows[0]["block"], "node": _grown(rows)[1]} for rows in runs(batches)), ROOT)

    up = blocks(nodes.select("grp", "pos", "n", "node"))
    counts = nodes.groupBy("grp").agg(F.ceil(F.first("n") / FAN**BLOCK_LEVELS).alias("n"))
    counts = counts.select(F.col("grp").alias("of"), "n")
    grown = up.mapInArrow(grow, "grp string, pos long, node string")
    return grown.join(counts, F.col("grp").eqNullSafe(F.col("of"))).drop("of")


def _above(witnesses: DataFrame) -> DataFrame:
    """Witnesses of blocks (grp, pos, siblings, places) as the first row of each block's task."""
    return witnesses.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "siblings", "places")


def extended(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """(grp, pos, siblings, places) of every node: its witness in its block, and after it that of the block."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[dict]:
            for rows in runs(batches):
                top = rows.pop(0) if rows[0]["pos"] < 0 else {"siblings": [], "places": []}
                tree, _, levels = _grown(rows)
                for k, row in enumerate(rows):
                    siblings, places = tree.witness(k, levels)
                    yield {"grp": row["grp"], "pos": row["pos"], "siblings": siblings + top["siblings"], "places": places + top["places"]}

        yield from batched(all_rows(), WITNESS)

    nodes = nodes.select("grp", "pos", "n", "node", F.lit(None).cast("array<string>").alias("siblings"), F.lit(None).cast("array<int>").alias("places"))
    more = [] if above is None else [_above(above)]
    return blocks(nodes, *more).mapInArrow(grow, "grp string, pos long, siblings array<string>, places array<int>")


def tree(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots of all groups (grp, node), and the tables of nodes (grp, pos, n, node) of each round, the first one first.

    A round cuts the number of nodes by the size of a block; its table is written, and the next one appends its roots.
    """
    rounds = [nodes]
    while True:
        rounds.append(keep(roots(rounds[-1]), "roots"))
        if rounds[-1].filter("n > 1").isEmpty():
            return rounds[-1].select("grp", "node"), rounds[:-1]


def descended(rounds: list[DataFrame], top: DataFrame | None) -> DataFrame | None:
    """Witnesses (grp, pos, siblings, places) of the blocks of the first round, from the last round down."""
    above = top
    for nodes in reversed(rounds[1:]):
        above = keep(extended(nodes, above), "witnesses")
    return above


PROOF = pa.schema([("grp", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.string()), ("folded_root", pa.string())])


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``changed`` is what a row's leaf is taken to be when its witness is folded; null or none: the leaf itself. Rows of a
    source ascend by doc_id, nulls first, and equal ids by leaf; rows that are equal in all fields have equal leaves in
    places of their own. A null source is a source, the first one. An empty table has no rows. Columns beyond the five
    fields aren't read.
    """
    prepare(docs.sparkSession)
    leaf = leaf_of()
    other = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("node"), other.alias("changed"))
    # Written first: sorting into ranges reads its rows twice, and texts are to be read and hashed once.
    leaves = keep(numbered(keep(rows, "hashes"), "grp", "doc_id", "node"), "leaves")
    subroots, rounds = tree(leaves)
    sources = keep(numbered(subroots.select(F.lit("").alias("all"), F.col("grp").alias("of"), "node"), "all", "of"), "sources")
    tops, top_rounds = tree(sources.select(F.col("all").alias("grp"), "pos", "n", "node"))
    # Down again: the sources' witnesses in the last tree, then the blocks' in their sources.
    upper = extended(top_rounds[0].select("grp", "pos", "n", "node"), descended(top_rounds, None)).drop("grp")
    root = F.broadcast(tops.select(F.col("grp").alias("all"), F.col("node").alias("root")))  # one row
    named = sources.select("all", F.col("of").alias("grp"), "pos", F.col("node").alias("subroot")).join(upper, "pos").join(root, "all")
    named = keep(named.drop("all", "pos"), "named")
    above = descended(rounds, named.select("grp", F.lit(0).cast("long").alias("pos"), "siblings", "places"))
    above = above.withColumnRenamed("grp", "of")
    heads = above.join(named.select(F.col("grp").alias("same"), "subroot", "root"), F.col("of").eqNullSafe(F.col("same")))
    heads = heads.select(F.col("of").alias("grp"), F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "siblings", "places", "subroot", "root")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[dict]:
            for rows in runs(batches):
                top = rows.pop(0)
                grown, _, levels = _grown(rows)
                for k, row in enumerate(rows):
                    siblings, places = grown.witness(k, levels)
                    siblings, places = siblings + top["siblings"], places + top["places"]
                    yield {
                        "grp": row["grp"], "doc_id": row["doc_id"], "leaf": row["node"], "subroot": top["subroot"], "root": top["root"],
                        "proof": hashed("".join(siblings)), "folded_root": folded(row["changed"] or row["node"], siblings, places),
                    }

        yield from batched(all_rows(), PROOF)

    proved = blocks(leaves, heads).mapInArrow(prove, "source string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 5 divides the crc32 of the
    doc_id, the folded leaf is that of the text with A-Z in lower case; without a doc_id it is the leaf itself."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(text=lower))
    return manifest(docs, changed).drop("source")

"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern may be taken up to
``most`` times; the first pass over it is free and every further pass costs one more than the one before, so the cost is
convex. The flow gives every source its target with the least repetition. A pattern's share then becomes whole passes
over all its documents plus a seeded selection for the rest.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import keep, prepare, shielded
from .texts import flat, pieces

SEED = "mix-1"
#: The selection order has 48 bits, settled 12 at a time.
LEVELS, STEP = 4, 12


def count_words(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than space and \\t \\n \\v \\f \\r in each text."""
    data, starts = flat(column)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[:-1][starts[:-1] < len(data)]
    first[at] = inside[at]
    total = np.concatenate([[0], np.cumsum(first)])
    return total[starts[1:]] - total[starts[:-1]]


def sizes(docs: DataFrame, members: Column, order: Column) -> DataFrame:
    """(doc_id, pattern, u, size) of each row: its sources sorted with null last, its place in the seeded order, its words."""
    rows = docs.select("doc_id", members.alias("pattern"), order.alias("u"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], T.StructField("size", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.drop_columns("text").append_column("size", pa.array(count_words(part.column("text")), pa.int64()))

    return rows.mapInArrow(measure, schema)


def targets(words: dict, weights: dict, most: int, total: int) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its source's words, what is over goes to the others."""
    out, open_ = {}, dict.fromkeys(words)
    while open_:
        weight = sum(weights[s] for s in open_)
        left = total - sum(out.values())
        share = {s: left * weights[s] / weight for s in open_}
        full = [s for s in open_ if share[s] > most * words[s]]
        if not full:
            return out | share
        out |= {s: float(most * words[s]) for s in full}
        for s in full:
            del open_[s]
    return out


def components(patterns: list[tuple]) -> list[list[tuple]]:
    """Patterns that share sources, directly or through others, together."""
    top: dict = {}

    def find(s):
        while top[s] != s:
            top[s] = s = top[top[s]]
        return s

    for pattern in patterns:
        for s in pattern:
            top.setdefault(s, s)
            top[find(s)] = find(pattern[0])
    groups: dict = defaultdict(list)
    for pattern in patterns:
        groups[find(pattern[0]) if pattern else ()].append(pattern)
    return list(groups.values())


def flow(patterns: dict[tuple, int], wanted: dict, most: int) -> dict[tuple, int]:
    """Words taken of each pattern: a maximal flow of patterns to source targets at the least convex repetition cost.

    Patterns that share no source don't compete, so each component is a flow of its own; that of a pattern alone with
    its source is known. Patterns are taken in order, so that of flows of equal cost it is always the same one.
    """
    taken = {p: 0 for p in patterns}
    for group in components(sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])):
        if len(group) == 1 and len(group[0]) == 1:
            taken[group[0]] = min(round(wanted[group[0][0]]), most * patterns[group[0]])
        elif group[0]:
            sources = sorted({s for p in group for s in p}, key=lambda s: (s is None, s or ""))
            taken |= cheapest({p: patterns[p] for p in group}, {s: wanted[s] for s in sources}, most)
    return taken


def cheapest(patterns: dict[tuple, int], wanted: dict, most: int) -> dict[tuple, int]:
    """The flow of a component. Successive shortest paths; potentials keep Dijkstra's costs from being negative."""
    graph: dict = defaultdict(list)  # node -> [to, capacity, cost, place of the reverse arc]

    def arc(a, b, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for pattern, words in patterns.items():
        for again in range(most):
            arc("from", ("p", pattern), words, again)
        for source in pattern:
            arc(("p", pattern), ("s", source), most * words, 0)
    for source, target in wanted.items():
        arc(("s", source), "to", round(target), 0)
    height: dict = defaultdict(int)
    while True:
        best, via, queue, tick = {"from": 0}, {}, [(0, 0, "from")], 0
        while queue:
            d, _, node = heapq.heappop(queue)
            if d > best[node]:
                continue
            for place, (to, capacity, cost, _) in enumerate(graph[node]):
                step = d + cost + height[node] - height[to]
                if capacity > 0 and step < best.get(to, 1 << 60):
                    best[to], via[to], tick = step, (node, place), tick + 1
                    heapq.heappush(queue, (step, tick, to))
        if "to" not in best:
            break
        for node in graph:
            height[node] += best.get(node, best["to"])
        push, node = 1 << 62, "to"
        while node != "from":
            before, place = via[node]
            push, node = min(push, graph[before][place][1]), before
        node = "to"
        while node != "from":
            before, place = via[node]
            graph[before][place][1] -= push
            graph[node][graph[before][place][3]][1] += push
            node = before
    taken = {p: 0 for p in patterns}
    for to, capacity, _, back in graph["from"]:
        taken[to[1]] += graph[to][back][1]
    return taken


def cutoffs(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(pattern, last): per pattern, documents whose ``u`` is at most ``last`` have about ``need`` words together.

    ``rest`` has (pattern, need). A histogram of 4,096 bins finds the bin in which the sum is reached, then the bin's
    rows are split again; no sort or window sees more than the bins.
    """
    open_ = rest.filter("need > 0").select("pattern", "need", F.lit(0).cast("long").alias("bin"))
    for level in range(1, LEVELS + 1):
        shift = STEP * (LEVELS - level)
        inside = rows.withColumn("bin", F.shiftright("u", shift + STEP)).join(open_, ["pattern", "bin"])
        bins = inside.groupBy("pattern", "need", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("pattern").orderBy("bin")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("before", before).filter("before < need and before + size >= need")
        open_ = keep(found.select("pattern", (F.col("need") - F.col("before")).alias("need"), "bin", "size"), "cut")
        if level < LEVELS:
            open_ = open_.drop("size")
    # The bin is one place in the order now: it is in if that comes nearer to the need.
    return open_.select("pattern", F.when(F.col("need") * 2 >= F.col("size"), F.col("bin")).otherwise(F.col("bin") - 1).alias("last"))


def place_in_order(seed: str = SEED) -> Column:
    """48 bits of a seeded digest of doc_id; rows of one doc_id share a place and are taken together."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, LEVELS * STEP // 4), 16, 10).cast("long")


def pattern_of(members: Column | None) -> Column:
    return F.array_sort(F.array_distinct(F.array("source") if members is None else F.coalesce(members, F.array())))


def decide(docs: DataFrame, weights=None, members: Column | None = None, most: int = 3, seed: str = SEED):
    """Sizes of the rows, the decision for each pattern (passes over it, last place of the rest), and words and target of
    each source.

    ``members`` is an array of sources, by default the one in ``source``; null is a source of its own. No array
    is an empty one: nothing is taken of a document without sources. ``weights`` maps the sorted sources, null last, to
    weights, by default 1, 2, 3, 1, 2, 3 and so on. A null text has no words; rows of one doc_id are taken alike; an empty table gives an empty mix. The driver holds a number per membership pattern.
    """
    spark = prepare(docs.sparkSession)
    rows = keep(sizes(docs, pattern_of(members), place_in_order(seed)), "sizes")
    patterns = {tuple(r[0]): int(r[1]) for r in rows.groupBy("pattern").agg(F.sum("size")).collect()}
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(sources)} if weights is None else weights(sources)
    words = dict.fromkeys(sources, 0)
    for p, n in patterns.items():
        for s in p:
            words[s] += n
    wanted = targets(words, weights, most, sum(patterns.values()))
    taken = flow(patterns, wanted, most)
    plan = [(list(p), *(divmod(taken[p], n) if n else (0, 0))) for p, n in patterns.items()]
    plan = spark.createDataFrame(plan, T.StructType([rows.schema["pattern"], T.StructField("passes", T.LongType()), T.StructField("need", T.LongType())]))
    decided = plan.join(cutoffs(rows, plan), "pattern", "left").select("pattern", "passes", F.coalesce("last", F.lit(-1)).alias("last"))
    return rows, decided, words, wanted


def copies(u: Column) -> Column:
    return F.col("passes") + (u <= F.col("last")).cast("long")


def mix(docs: DataFrame, members: Column | None = None, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size and target of its source, and the words the mix takes of it.

    With ``members``, ``sources`` has the document's sources in order, null last, and source_size and target are arrays
    with a value for each of them.
    """
    rows, decided, words, wanted = decide(docs, members=members, **options)
    patterns = [[s] for s in words] if members is None else [r[0] for r in decided.select("pattern").collect()]
    numbers = [(p, [int(words[s]) for s in p], [float(wanted[s]) for s in p]) for p in patterns]
    schema = T.StructType([rows.schema["pattern"], T.StructField("source_size", T.ArrayType(T.LongType())), T.StructField("target", T.ArrayType(T.DoubleType()))])
    per_pattern = docs.sparkSession.createDataFrame(numbers, schema)
    taken = (F.col("size") * copies(F.col("u"))).alias("taken")
    found = rows.join(decided, "pattern").join(per_pattern, "pattern")
    if members is None:
        return found.select("doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"), taken)
    return found.select("doc_id", F.col("pattern").alias("sources"), "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, seed: str = SEED, members: Column | None = None, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, with the columns of ``docs``, whatever their
    names. A null text has no words and is taken as often as its place in the order says; rows of one doc_id are taken
    alike; a null source is one of its own; an empty table stays empty."""
    _, decided, _, _ = decide(docs, seed=seed, members=members, **options)
    rows, restored = shielded(docs, pattern_of(members).alias("pattern"), place_in_order(seed).alias("u"))
    joined = rows.join(decided, "pattern")
    return restored(joined.withColumn("again", F.explode(F.array_repeat(F.lit(1), copies(F.col("u")).cast("int")))))

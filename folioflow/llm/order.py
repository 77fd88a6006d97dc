"""Cutting a table into shards of about equal numbers of rows in the order of a key, the same on every run."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep


#: Shards of a table at most: the driver holds two keys of each.
MOST = 50_000


def shards(df: DataFrame, key: str, rows: int, most: int = MOST) -> list[tuple]:
    """(first key, last key) of each run of ``rows`` rows in ascending order of ``key``; nulls come first and don't count.

    Runs are longer where there would be more than ``most`` of them. Only keys are sorted. The driver gets a number per partition and two keys per shard. Rows of one key share a shard:
    a key that would reach into the next shard is the last of its own.
    """
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("key", df.schema[key].dataType)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), batch.column(0)], names=["part", "at", "key"])
            at += n

    keys = df.select(F.col(key).alias("key")).filter("key is not null")
    numbered = keep(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(number, schema), "order")
    counts = sorted((r[0], r[1]) for r in numbered.groupBy("part").count().collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not total:
        return []
    rows = max(rows, math.ceil(total / most))
    starts = df.sparkSession.createDataFrame(starts, "part long, start long")
    place = numbered.join(starts, "part").select("key", (F.col("start") + F.col("at")).alias("place"))
    edges = place.filter((F.pmod("place", F.lit(rows)) == 0) | (F.pmod("place", F.lit(rows)) == rows - 1) | (F.col("place") == total - 1))
    at = {r.place: r.key for r in edges.collect()}
    out: list[tuple] = []
    for first in range(0, total, rows):
        a, b = at[first], at[min(first + rows, total) - 1]
        if out and a == out[-1][1]:  # its rows are all in the shard before
            if b == a:
                continue
            # The first key after the shared one isn't known here; any key above a goes to this shard.
        out.append((a, b))
    return out


def shard_of(key: Column, cuts: list[tuple]) -> Column:
    """The shard of a key, by binary search among the last keys of the shards; null is in the first."""
    if len(cuts) < 2:
        return F.lit(0)
    last = F.lit([b for _, b in cuts[:-1]])
    state = F.struct(F.lit(0).alias("a"), F.lit(len(cuts) - 1).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["a"] + s["b"]) / 2).cast("int")
        above = (s["a"] < s["b"]) & (F.get(last, middle) < key)
        below = (s["a"] < s["b"]) & ~above
        return F.struct(F.when(above, middle + 1).otherwise(s["a"]).alias("a"), F.when(below, middle).otherwise(s["b"]).alias("b"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(cuts))) + 1))
    return F.when(key.isNull(), 0).otherwise(F.aggregate(steps, state, halve)["a"]).cast("int")

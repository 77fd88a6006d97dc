"""Joins on keys that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join ``table`` on ``key``, a number that may be NULL in many rows.

    NULL matches nothing, yet a shuffled join would gather all such rows in one task. So the join has a second key, made
    of the id in ``spread`` where the first is NULL, and else the same on both sides.
    """
    mine = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.col(key) * 0)
    found = table.withColumnRenamed(key, "_key").withColumn("_spread", F.col("_key") * 0)
    return (
        rows.withColumns({"_key": F.col(key), "_spread": mine})
        .join(found, ["_key", "_spread"], "left")
        .drop("_key", "_spread")
    )

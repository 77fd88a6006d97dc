"""Looking back over a long sorted list, or adding it up, without putting the list into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

def in_runs(df: DataFrame, sequence: list[Column], order: list[Column]) -> DataFrame:
    """Add ``_run``: the number of a contiguous run of the rows in order.

    Runs are ranges of the whole list, cut where they have about the same number of rows, so a sequence or a key within
    it that holds most rows is cut into as many runs as it has ranges. ``order`` ends in a unique key.
    """
    runs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(runs, *sequence, *order).withColumn("_run", F.spark_partition_id())


def with_previous_row(df: DataFrame, columns: list[str], sequence: list[Column], order: list[Column]) -> DataFrame:
    """Add ``previous``: a struct of ``columns`` from the row before, NULL at the start of a sequence.

    A plain ``lag`` sends a whole sequence to one task, and a single journal, day or entry may hold a third of all rows.
    So rows look back inside their run; the first and last row of a run go on to a second look over the run borders of
    their sequence, at most two for each run, where the first row finds its neighbour.
    """
    here = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy(*sequence, "_run").orderBy(*order)
    out = in_runs(df, sequence, order).select(
        "*", F.lag(here).over(inside).alias("_back"), F.lead(F.lit(True)).over(inside).isNull().alias("_last")
    )
    first = F.col("_back").isNull()
    # Rows that are settled stay in small windows of their run.
    out = out.withColumn("_settled", F.when(~(first | F.col("_last")), F.col("_run")))
    borders = Window.partitionBy(*sequence, "_settled").orderBy(*order)
    found = F.when(first, F.lag(here).over(borders)).otherwise(F.col("_back"))
    return out.select(*df.columns, found.alias("previous"))


def with_running_sum(df: DataFrame, measure: str, name: str, sequence: list[str], order: list[Column]) -> DataFrame:
    """Add ``name``: the sum of ``measure`` over the rows of a sequence up to each row; NULL adds nothing.

    Rows are summed inside their run, and a run starts from the sum of the runs before it, of which there is one number
    for each run of a sequence. ``order`` ends in a unique key. Rows are written with their runs, since both sums must see
    the same ones.
    """
    runs = written(in_runs(df, [F.col(c) for c in sequence], order), "runs")
    sums = runs.groupBy(*[F.col(c).alias(f"_of_{c}") for c in sequence], F.col("_run").alias("_of_run")).agg(F.sum(measure).alias("_sum"))
    earlier = Window.partitionBy(*[f"_of_{c}" for c in sequence]).orderBy("_of_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.sum("_sum").over(earlier)).drop("_sum")
    same = F.col("_run") == F.col("_of_run")
    for c in sequence:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy(*sequence, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(measure).over(inside)
    zero = F.lit(0)
    # The window comes first: it is over rows and runs alone, and the join adds one number to each row.
    rows = runs.withColumn("_own", own).join(starts, same)
    return rows.select(*df.columns, (F.coalesce("_start", zero) + F.coalesce("_own", zero)).alias(name))

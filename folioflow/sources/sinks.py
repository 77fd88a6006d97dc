"""Publishing report results: a full refresh per run, as the analysis screens expect, or of the months that changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import ENTRY_MONTH, OTHER_MONTH
from .scratch import written

LOAD_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def with_load_time(report: DataFrame, moment: datetime) -> DataFrame:
    """Add the create_date and write_date of the load."""
    stamp = F.to_timestamp(F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")), LOAD_TIME_FORMAT)
    return report.withColumns({"create_date": stamp, "write_date": stamp})


def refresh_table(report: DataFrame, table: str, month_of: str | None = None) -> None:
    """Replace a result table, partitioned by the month of a date column where one is given."""
    if month_of is not None:
        report = report.withColumn("month", F.date_format(month_of, "yyyy-MM"))
        # Months meet in few tasks, and a large month is split again: not a file per task and month.
        report = report.hint("rebalance", "month")
    writer = report.write.mode("overwrite")
    if month_of is not None:
        writer = writer.partitionBy("month")
    writer.saveAsTable(table)


def replace_partitions(rows: DataFrame, table: str) -> None:
    """Replace those partitions of a table that have rows here; others, and their files, stay as they are."""
    spark, option = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(option)
    spark.conf.set(option, "dynamic")
    try:
        rows.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(option, before)


def _digests(report: DataFrame) -> DataFrame:
    """(month, n, digest): per month the number of rows, and sums of numbers and row hashes that don't depend on their order."""
    columns = [c for c in report.columns if c != "month"]
    numbers = [f.name for f in report.schema.fields if isinstance(f.dataType, (T.DecimalType, T.IntegerType, T.LongType)) and f.name != "month"]
    own = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    sums = [F.sum(F.col(f"`{c}`").cast("decimal(38,6)")).cast("string") for c in numbers]
    parts = F.concat_ws("|", F.sum(own.cast("decimal(38,0)")).cast("string"), F.bit_xor(own).cast("string"), *[F.coalesce(s, F.lit("-")) for s in sums])
    return report.groupBy(F.coalesce("month", F.lit(_NO_MONTH)).alias("month")).agg(F.count("*").alias("n"), parts.alias("digest"))


_NO_MONTH = "none"


def _exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def refresh_months(report: DataFrame, table: str, month_of: str) -> list[str]:
    """Bring a result table up to date, month by month: only months whose rows differ are written. Returns them.

    Beside the table is ``<table>_months`` with the number of rows, exact sums and row hashes of each stored month. Months that
    differ replace theirs; a month without rows any more is dropped. Readers see a month's old rows or its new ones, and
    never an empty table. The report is computed once. A run that stops in between leaves old numbers beside new rows, so
    the next one writes those months again. Floating-point columns count in the row hashes, so a month whose sums were
    added in another order may be written again.
    """
    spark, beside = report.sparkSession, f"{table}_months"
    report = written(report.withColumn("month", F.date_format(month_of, "yyyy-MM")), "report")
    now = written(_digests(report), "digests")
    if not (_exists(spark, table) and _exists(spark, beside)):
        report.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").saveAsTable(table)
        now.coalesce(1).write.mode("overwrite").saveAsTable(beside)
        return sorted(r.month for r in now.select("month").collect())
    stored = spark.table(beside).select("month", F.struct("n", "digest").alias("stored"))
    both = now.select("month", F.struct("n", "digest").alias("now")).join(stored, "month", "full")
    # A row per month on the driver.
    changed = both.filter(~F.col("now").eqNullSafe(F.col("stored"))).select("month", F.col("now").isNull().alias("gone")).collect()
    fresh, gone = [r.month for r in changed if not r.gone], [r.month for r in changed if r.gone]
    if fresh:
        rows = report.filter(F.coalesce("month", F.lit(_NO_MONTH)).isin(*fresh))
        replace_partitions(rows.hint("rebalance", "month"), table)
    for month in gone:
        value = "null" if month == _NO_MONTH else f"'{month}'"
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (month = {value})")
    if changed:
        now.coalesce(1).write.mode("overwrite").saveAsTable(beside)
        spark.catalog.refreshTable(table)
    return sorted(r.month for r in changed)


def store_ledger(lines: DataFrame, moves: DataFrame, table: str) -> None:
    """Store ledger lines by month, so that reports of a period read its months only.

    Some reports go by a line's date and some by its entry's; a line is stored under the month that both have. Lines whose
    dates differ, or that lack an entry or a date, are kept apart and read for every period. Rows of a month meet before
    they are written, and a large month is split again: no file per task and month.
    """
    entries = moves.select(F.col("id").alias("_entry"), F.date_format("date", "yyyy-MM").alias("_month"))
    own = F.date_format("date", "yyyy-MM")
    rows = lines.join(entries, lines["move_id"] == entries["_entry"], "left")
    rows = rows.withColumn(ENTRY_MONTH, F.when(own == F.col("_month"), own).otherwise(OTHER_MONTH))
    rows.select(*lines.columns, ENTRY_MONTH).hint("rebalance", ENTRY_MONTH).write.mode("overwrite").partitionBy(ENTRY_MONTH).saveAsTable(table)


def store_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a large table by ``key``, so that joins of tables stored alike need no shuffle.

    Ledger lines by ``move_id`` and entries by ``id`` is the pair most reports join. A join without a shuffle can't be
    split at run time, so a key with a large share of the rows is better stored without buckets.
    """
    rows = rows.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def export_files(report: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write a labelled report for download: ``parquet``, or ``csv`` with a heading line."""
    writer = report.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_format).save(path)

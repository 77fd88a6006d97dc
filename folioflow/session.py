"""Spark sessions for the reports."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A hot order, partner or product may fill one join partition; let AQE split it even where the split
# costs a shuffle more.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A period is a filter on entries. Where lines and entries are shuffled for their join, Spark first drops lines that have no
    # such entry, by a Bloom filter of the entries. Its default limits are for smaller tables than a ledger's entries of a
    # year; these bound it at 32 MB, which is what travels to the tasks.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "2GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "8000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "32000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 28),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the reports count on."""
    for option, value in RUNTIME.items():
        spark.conf.set(option, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine, as tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioflow")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)

"""Hot keys and missing keys do not end in one task."""

import pytest
from pyspark.sql import functions as F
from skewed import write_skewed

from folioflow.functions.joins import lookup
from folioflow.plans.catalogue import run

SMALL_SCALE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    return write_skewed("/root/testdata/sf0.01", str(tmp_path_factory.mktemp("skew")), files=8)


@pytest.fixture
def small_scale(spark):
    for option, value in SMALL_SCALE.items():
        spark.conf.set(option, value)
    yield
    for option in SMALL_SCALE:
        spark.conf.unset(option)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["ledger_by_account", "journal_audit", "sales_lines", "product_margin", "trial_balance"])
def test_hot_join_partitions_are_split(spark, skewed, small_scale, name):
    report = run(name, spark, skewed)
    report.collect()
    assert "skew=true" in report._jdf.queryExecution().executedPlan().toString()


def test_lookup_spreads_missing_keys(spark, small_scale):
    rows = spark.range(4000).selectExpr("id", "IF(id % 4 = 0, id % 3, NULL) AS who")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "who bigint, name string")
    found = lookup(rows, names, "who", "id")
    assert found.columns == ["id", "who", "name"]
    assert found.filter("name IS NOT NULL").count() == rows.filter("who IN (0, 1)").count()
    assert found.filter("who IS NULL").count() == 3000

    sent = found.withColumn("task", F.spark_partition_id()).filter("who IS NULL").groupBy("task").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in sent.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 16 and max(sizes) < 400

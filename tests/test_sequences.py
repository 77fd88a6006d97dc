"""Looking back over run borders gives what one long window gives, without a large window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from skewed import write_skewed

from folioflow.functions.sequences import in_runs, with_previous_row, with_running_sum
from folioflow.operators import journals
from folioflow.plans.catalogue import BOOK
from folioflow.sources import StarTables


@pytest.fixture(params=[1, 5, 60])
def runs(request, spark):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_a_plain_lag(spark, seed, runs):
    rng = random.Random(seed)
    rows = [(n, rng.choice("aab"), rng.randrange(12), rng.choice("xyz"), rng.choice(["u", "v", None])) for n in range(400)]
    df = spark.createDataFrame(rows, "id bigint, seq string, entry bigint, code string, value string").repartition(5)
    order = [F.col("entry"), F.col("code"), F.col("id")]
    got = with_previous_row(df, ["value", "entry"], [F.col("seq")], order)
    want = df.withColumn("previous", F.lag(F.struct("value", "entry")).over(Window.partitionBy("seq").orderBy(*order)))
    assert sorted(got.select("id", "previous").collect(), key=lambda r: r.id) == sorted(
        want.select("id", "previous").collect(), key=lambda r: r.id
    )
    assert got.columns == [*df.columns, "previous"]


@pytest.mark.parametrize("leading", ["date", "move"])
def test_a_hot_entry_is_cut_into_runs(spark, tmp_path_factory, leading):
    """On the skewed tables one entry has a third of the rows; no run has many more than its share."""
    tables = StarTables(spark, write_skewed("/root/testdata/sf0.01", str(tmp_path_factory.mktemp("hot")), files=4))
    rows = journals._named_lines(tables, BOOK)
    order = [F.col(c) for c in ("move_id", "account_code", "label", "debit", "credit", "line_id")]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        cut = in_runs(rows, [F.col("journal_id"), F.col(leading)], order)
        sizes = [r["count"] for r in cut.groupBy("journal_id", leading, "_run").count().collect()]
        total, hottest = sum(sizes), rows.groupBy("move_id").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert hottest > total / 4
    assert max(sizes) < 4 * total / 40


def test_running_sum_by_adding_up(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(n, pick.choice(["a", "a", "a", "b", None]), pick.choice([None, 1, -2, 5])) for n in range(3000)]
    df = spark.createDataFrame(rows, "n int, k string, v int").repartition(6)
    expected, sums = {}, {}
    for n, k, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        expected[n] = sums[k]
    got = with_running_sum(df, "v", "total", ["k"], [F.col("n")])
    assert got.columns == ["n", "k", "v", "total"]
    assert {r.n: r.total for r in got.collect()} == expected


def test_running_sum_of_one_key_is_spread(spark):
    """A key that has all rows is cut into as many windows as there are runs."""
    df = spark.range(40_000).selectExpr("id AS n", "1 AS k", "1 AS v")
    runs = in_runs(df, [F.col("k")], [F.col("n")]).groupBy("_run").count().collect()
    assert len(runs) > 4 and max(r["count"] for r in runs) < 0.3 * 40_000
    assert with_running_sum(df, "v", "total", ["k"], [F.col("n")]).filter("total <> n + 1").count() == 0

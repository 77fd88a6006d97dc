"""What the plans must look like to hold at scale."""

import re

import pytest

from folioflow import Tables
from folioflow.operators import journals, pivots
from folioflow.plans.catalogue import PERIOD, REPORTS, run

# Reports that end in sums over everything; each side of the exchange has one row per task.
WHOLE_TOTALS = {
    "trial_balance_total", "trial_balance_levels", "trial_balance_levels_by_partner", "sales_order_totals", "list_footers"
}


@pytest.fixture
def static_plans(spark):
    """Plans with every join shuffled that need not be, as with tables too large to broadcast."""
    options = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "20000"}

    def plan(name, sf_dir):
        report = run(name, spark, sf_dir)
        for option, value in options.items():
            spark.conf.set(option, value)
        return report._jdf.queryExecution().executedPlan().toString()

    yield plan
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def lineitem_scans(plan):
    return len(re.findall(r"FileScan parquet \[[^\]]*\bl_", plan))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_cross_join_no_python_no_single_task(static_plans, sf_dir, name):
    plan = static_plans(name, sf_dir)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", plan)
    if name not in WHOLE_TOTALS:
        assert "SinglePartition" not in plan


@pytest.mark.parametrize(
    "name",
    ["trial_balance", "trial_balance_by_partner", "trial_balance_levels", "trial_balance_levels_by_partner",
     "trial_balance_total", "ledger_by_account", "ledger_by_partner", "journal_audit", "journal_audit_labelled",
     "journal_book_print_rows", "journal_book_totals", "sales_lines", "sales_pivot", "journal_pivot",
     "ledger_by_account_partner", "purchase_pivot", "journal_pivot_totals"],
)
def test_one_scan_of_the_lines(static_plans, sf_dir, name):
    assert lineitem_scans(static_plans(name, sf_dir)) == 1


@pytest.mark.parametrize(
    "name", ["ledger_combined", "ledger_combined_v2", "ledger_combined_by_account_partner", "partner_subtotals"]
)
def test_two_scans_of_the_lines(static_plans, sf_dir, name):
    """The detail and the subtotals, or two sets of filters."""
    assert lineitem_scans(static_plans(name, sf_dir)) == 2


def test_roll_up_starts_from_written_subtotals(static_plans, sf_dir):
    """The lines are read for the subtotals, which the listing and the roll-up then share."""
    assert lineitem_scans(static_plans("ledger_group_rollup", sf_dir)) == 0


def test_taxes_and_layers_are_cut_down_before_they_are_grouped(static_plans, sf_dir):
    """Below the grouping of taxes by line, and of layers by product, is a semi join with the chosen lines."""
    for name in ("purchase_lines", "purchase_lines_labelled"):
        assert static_plans(name, sf_dir).count("LeftSemi") >= 4


def test_scan_reads_used_columns_and_gets_the_dates(static_plans, sf_dir):
    plan = static_plans("trial_balance_no_analytic", sf_dir)
    (columns,) = re.findall(r"FileScan parquet \[([^\]]*\bl_[^\]]*)\]", plan)
    names = {re.sub(r"#.*", "", c) for c in columns.split(",")}
    assert {n for n in names if n.startswith("l_")} == {
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"
    }
    assert "LessThan(o_orderdate,1999-01-01" in plan


def test_a_period_of_entries_filters_the_lines_before_their_shuffle(spark, star, tmp_path):
    """With entries too many to broadcast, the scan of the lines is filtered by a Bloom filter of the period's entries."""
    for name in ("account_move", "account_move_line"):
        star[name].repartition(4).write.parquet(f"{tmp_path}/{name}")
    tables = Tables.from_parquet(spark, str(tmp_path))
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1"}
    for option, value in options.items():
        spark.conf.set(option, value)
    try:
        for report in (journals._audit(tables, PERIOD), pivots.journal_pivot(tables, PERIOD)):
            plan = report._jdf.queryExecution().optimizedPlan().toString()
            assert "might_contain" in plan
    finally:
        for option in options:
            spark.conf.unset(option)
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold") == "2GB"


def test_distinct_entries_are_counted_without_wide_rows(static_plans, sf_dir):
    """An aggregate sorts its input where its state isn't of fixed size, such as bitmaps of 4 KB for each cell."""
    plan = static_plans("journal_pivot_totals", sf_dir)
    assert "HashAggregate" in plan
    assert not re.search(r"SortAggregate|ObjectHashAggregate|bitmap", plan)

"""Every registered report against its SQL counterpart, on the test tables and on a skewed copy."""

import pytest
from compare import connect, differences
from skewed import write_skewed

import __spark_entry__ as contract
from folioflow.plans.catalogue import REPORTS
from folioflow.plans.oracle import ORACLE

NAMES = sorted(REPORTS)


def test_every_report_has_sql():
    assert set(NAMES) == set(ORACLE) and set(NAMES) <= set(contract.queries())


@pytest.fixture(scope="module")
def plain(sf_dir):
    return sf_dir, connect(sf_dir)


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    """A third of the rows on one key each, the lines in several files with a blank in their names."""
    root = write_skewed(sf_dir, str(tmp_path_factory.mktemp("skewed tables")), files=5)
    return root, connect(root)


@pytest.mark.parametrize("name", NAMES)
def test_report_matches_sql(spark, plain, name):
    root, con = plain
    assert differences(contract.queries()[name](spark, root), con, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_report_matches_sql_on_skewed_tables(spark, skewed, name):
    root, con = skewed
    assert differences(contract.queries()[name](spark, root), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    report = contract.entry(spark)
    assert report.columns[:3] == ["bold", "group", "account_id"]
    assert report.count() == 66


# Row counts recorded in FIXTURES.md for the smallest tables.
ANCHORS = {
    "ledger_detail": 151,
    "trial_balance": 66,
    "trial_balance_by_partner": 518,
    "journal_audit": 910,
    "purchase_lines": 132,
    "sales_lines": 85,
    "product_margin": 57,
    "stock_availability": 391,
    "inventory_transfers": 246,
    "inventory_categories": 1905,
    "invoice_detail": 14,
}


@pytest.mark.parametrize("name", sorted(ANCHORS))
def test_row_counts(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() == ANCHORS[name]


def test_no_report_is_empty():
    """A report without rows proves nothing by matching its SQL."""
    con = connect("/root/testdata/sf0.01")
    assert [n for n in NAMES if con.execute(f"select count(*) from ({ORACLE[n]})").fetchone()[0] == 0] == []

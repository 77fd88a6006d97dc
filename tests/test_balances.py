"""Reports over balances of closed months are the plain reports, and read no older lines."""

import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from erp import erp, money
from pyspark.sql import functions as F

from folioflow import BalanceParams, LedgerParams
from folioflow.operators import ledger, trial_balance
from folioflow.sources.balances import BalanceCube, close_months, closed_until, month_balances, read_cube, store_cube, with_cube
from folioflow.sources.sinks import store_ledger

START, END = date(1998, 3, 11), date(1998, 6, 20)
LEDGER = LedgerParams(START, END, (1, 2))
BALANCE = BalanceParams(START, END, (1, 2))

REPORTS = {
    "by_account": lambda t: ledger.ledger_by_account(t, LEDGER),
    "by_account_ifrs": lambda t: ledger.ledger_by_account(t, replace(LEDGER, book="ifrs", omit_zero=False, posted_only=False)),
    "by_partner": lambda t: ledger.ledger_by_partner(t, LEDGER),
    "by_account_partner": lambda t: ledger.ledger_by_account_partner(t, LEDGER),
    "filtered": lambda t: ledger.ledger_by_account(t, replace(LEDGER, accounts=(1,), partners=(1, 2), analytics=(1,))),
    "combined": lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account", "account_partner"))),
    "combined_v2": lambda t: ledger.ledger_combined_v2(t, replace(LEDGER, levels=("partner",))),
    "with_balances": lambda t: ledger.ledger_detail_with_balances(t, LEDGER),
    "partner_subtotals": lambda t: ledger.partner_subtotals(t, LEDGER),
    "partner_subtotals_ifrs": lambda t: ledger.partner_subtotals(t, replace(LEDGER, book="ifrs")),
    "rollup": lambda t: ledger.ledger_group_rollup(t, LEDGER),
    "running": lambda t: ledger.ledger_running_balance(t, LEDGER),
    "trial": lambda t: trial_balance.trial_balance(t, BALANCE),
    "trial_ifrs": lambda t: trial_balance.trial_balance(t, replace(BALANCE, book="ifrs", omit_zero=False)),
    "trial_by_partner": lambda t: trial_balance.trial_balance(t, replace(BALANCE, by_partner=True)),
    "levels": lambda t: trial_balance.trial_balance_levels(t, BALANCE),
    "total": lambda t: trial_balance.trial_balance_total(t, replace(BALANCE, by_analytic=False)),
}


def lines(n=1500):
    pick = random.Random(4)

    def side():
        return None if pick.random() < 0.1 else money(pick.choice((0, 0, 1.25, 3.5, 100)))

    out = []
    for _ in range(n):
        day = None if pick.random() < 0.02 else date(1997, 10, 1) + timedelta(pick.randrange(300))
        out.append(
            {
                "date": day, "account_id": pick.choice((1, 2, 3)), "partner_id": pick.choice((1, 2, None)),
                "analytic_account_id": pick.choice((1, None)), "company_id": pick.choice((1, 2, 3)),
                "parent_state": pick.choice(("posted", "posted", "draft")), "ifrs_type": pick.choice(("both", "local", "ifrs", None)),
                "debit": side(), "credit": side(), "ifrs_debit": side(), "ifrs_credit": side(),
            }
        )
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return erp(spark, lines())


def rows(report):
    """Rows with amounts as numbers: sums of sums are wider decimals of the same value."""
    cells = [F.col(f"`{f.name}`").cast("decimal(38,4)") if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`") for f in report.schema.fields]
    return sorted(map(tuple, report.select(*cells).collect()), key=str)


@pytest.mark.parametrize("name", sorted(REPORTS))
@pytest.mark.parametrize("closed", [date(1998, 2, 1), date(1998, 5, 1)])
def test_the_same_report_with_months_kept(tables, name, closed):
    kept = with_cube(tables, BalanceCube(month_balances(tables["account_move_line"]), closed))
    assert rows(REPORTS[name](kept)) == rows(REPORTS[name](tables)) != []


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_older_lines_are_not_read(spark, tables, name):
    """Without the lines of closed months, their balances give the same report."""
    all_lines = tables["account_move_line"]
    recent = erp(spark, lines())
    recent._opened["account_move_line"] = all_lines.filter(F.col("date") >= F.lit(date(1998, 3, 1)))
    kept = with_cube(recent, BalanceCube(month_balances(all_lines), date(1998, 3, 1)))
    assert rows(REPORTS[name](kept)) == rows(REPORTS[name](tables))


@pytest.fixture
def schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_months")
    yield "kept_months"
    spark.sql("DROP DATABASE kept_months CASCADE")


def test_months_are_closed_one_after_another(spark, tables, schema):
    all_lines = tables["account_move_line"]
    store_cube(all_lines, f"{schema}.months", date(1998, 1, 1))
    files = set(spark.table(f"{schema}.months").inputFiles())
    close_months(all_lines.filter("date >= '1998-01-01'"), f"{schema}.months", date(1998, 3, 1))
    close_months(all_lines, f"{schema}.months", date(1998, 2, 1))  # closed already
    assert closed_until(spark, f"{schema}.months") == date(1998, 3, 1)
    assert files < set(spark.table(f"{schema}.months").inputFiles())
    kept = with_cube(tables, read_cube(spark, f"{schema}.months"))
    for name in REPORTS:
        assert rows(REPORTS[name](kept)) == rows(REPORTS[name](tables))


def test_a_stored_ledger_is_scanned_from_the_open_month_on(spark, tables, schema, capsys):
    store_ledger(tables["account_move_line"], tables["account_move"], f"{schema}.lines")
    stored = erp(spark, lines())
    stored._opened["account_move_line"] = spark.table(f"{schema}.lines")
    store_cube(tables["account_move_line"], f"{schema}.months", date(1998, 3, 1))
    report = trial_balance.trial_balance(with_cube(stored, read_cube(spark, f"{schema}.months")), BALANCE)
    report.explain("formatted")
    plan = capsys.readouterr().out
    assert "(entry_month" in plan and ">= 1998-03)" in plan
    assert rows(report) == rows(trial_balance.trial_balance(tables, BALANCE))


def test_closed_is_a_first_day(spark, tables):
    with pytest.raises(ValueError, match="first day"):
        BalanceCube(tables["account_move_line"], date(1998, 3, 2))

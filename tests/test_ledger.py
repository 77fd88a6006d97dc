from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from erp import erp, money

from folioflow import LedgerParams
from folioflow.operators import ledger

P = LedgerParams(date(1998, 1, 1), date(1998, 12, 31), (1,))
BEFORE, INSIDE, AFTER = date(1997, 6, 1), date(1998, 6, 1), date(1999, 6, 1)


def amounts(row):
    return tuple(float(row[c]) for c in ("initial", "debit", "credit", "final"))


def test_opening_movement_and_closing(spark):
    t = erp(spark, [
        {"date": BEFORE, "debit": money(10)},
        {"date": INSIDE, "credit": money(4)},
        {"date": AFTER, "debit": money(100)},
    ])
    (row,) = ledger.ledger_by_account(t, P).collect()
    assert amounts(row) == (10, 0, 4, 6)
    assert row.bold and row.code == "143501" and row.date is None


def test_opening_only_key_is_not_listed(spark):
    t = erp(spark, [{"date": BEFORE, "debit": money(10)}, {"date": INSIDE, "debit": money(1), "account_id": 2}])
    assert [r.account_id for r in ledger.ledger_by_account(t, P).collect()] == [2]


def test_first_and_last_day_are_inside(spark):
    t = erp(spark, [{"date": P.date_from, "debit": money(1)}, {"date": P.date_to, "debit": money(2)}])
    (row,) = ledger.ledger_by_account(t, P).collect()
    assert amounts(row) == (0, 3, 0, 3)


def test_no_partner_is_a_partner_of_its_own(spark):
    t = erp(spark, [
        {"partner_id": None, "date": BEFORE, "debit": money(5)},
        {"partner_id": None, "date": INSIDE, "debit": money(7)},
        {"partner_id": 2, "date": INSIDE, "debit": money(9)},
    ])
    rows = {r.partner: amounts(r) for r in ledger.ledger_by_partner(t, P).collect()}
    assert rows == {"**": (5, 7, 0, 12), "Bo": (0, 9, 0, 9)}
    rows = {r.partner: amounts(r) for r in ledger.ledger_by_account_partner(t, P).collect()}
    assert rows == {"**": (5, 7, 0, 12), "Bo": (0, 9, 0, 9)}


def test_balances_repeat_on_each_entry(spark):
    t = erp(spark, [
        {"date": BEFORE, "debit": money(5)},
        {"date": INSIDE, "debit": money(1), "move_id": 1},
        {"date": INSIDE, "debit": money(2), "move_id": 2},
    ], moves=[{"id": 1}, {"id": 2}])
    rows = sorted(amounts(r) for r in ledger.ledger_by_account_partner(t, P).collect())
    assert rows == [(5, 1, 0, 8), (5, 2, 0, 8)]


def test_line_without_ifrs_type_is_in_no_book(spark):
    t = erp(spark, [{"ifrs_type": None, "debit": money(5), "ifrs_debit": money(5)}])
    assert ledger.ledger_detail(t, P).count() == 0
    assert ledger.ledger_detail(t, replace(P, book="ifrs")).count() == 0


def test_books(spark):
    t = erp(spark, [
        {"ifrs_type": "local", "debit": money(1), "ifrs_debit": money(2)},
        {"ifrs_type": "ifrs", "debit": money(4), "ifrs_debit": money(8)},
        {"ifrs_type": "both", "debit": money(16), "ifrs_debit": money(32)},
    ])
    assert sum(r.debit for r in ledger.ledger_detail(t, P).collect()) == 17
    assert sum(r.debit for r in ledger.ledger_detail(t, replace(P, book="ifrs")).collect()) == 40


def test_omit_zero_drops_lines_in_balance(spark):
    t = erp(spark, [{"debit": money(5), "credit": money(5)}, {"debit": money(0)}, {"debit": money(1)}])
    assert ledger.ledger_detail(t, P).count() == 1
    assert ledger.ledger_detail(t, replace(P, omit_zero=False)).count() == 3


def test_opening_skips_a_line_with_one_side_missing(spark):
    t = erp(spark, [
        {"date": BEFORE, "debit": money(10), "credit": None},
        {"date": BEFORE, "debit": money(3)},
        {"date": INSIDE, "debit": money(2), "credit": None},
    ])
    (row,) = ledger.ledger_by_account(t, P).collect()
    assert amounts(row) == (3, 2, 0, 3)


def test_filters(spark):
    t = erp(spark, [
        {"debit": money(1), "company_id": 2},
        {"debit": money(2), "parent_state": "draft"},
        {"debit": money(4), "partner_id": 2, "analytic_account_id": 1},
        {"debit": money(8), "account_id": 2},
    ])

    def total(p):
        return sum((r.debit for r in ledger.ledger_detail(t, p).collect()), Decimal(0))

    assert total(P) == 12
    assert total(replace(P, posted_only=False)) == 14
    assert total(replace(P, companies=(1, 2))) == 13
    assert total(replace(P, partners=(2,))) == 4
    assert total(replace(P, accounts=(2,))) == 8
    assert total(replace(P, analytics=(1,))) == 4
    assert total(replace(P, accounts=spark.createDataFrame([(2,)], "id bigint"))) == 8


def test_optional_columns(spark):
    t = erp(spark, [{"debit": money(1), "analytic_account_id": 1, "currency_id": 1, "amount_currency": money(3)}])
    wide = replace(P, with_analytic=True, with_currency=True)
    (row,) = ledger.ledger_detail(t, wide).collect()
    assert (row.analytic, row.currency, float(row.amount)) == ("AN1", "COP", 3.0)
    columns = ledger.ledger_detail(t, wide).columns
    assert columns[8:14] == ["journal", "analytic", "move", "line", "currency", "amount"]
    for level in ("account", "partner", "account_partner"):
        assert ledger.ledger_combined(t, replace(wide, levels=(level,))).columns == columns


def mixed(spark):
    return erp(spark, [
        {"debit": money(1), "partner_id": 2},
        {"debit": money(2), "partner_id": 1},
        {"debit": money(4), "account_id": 2, "partner_id": None},
    ])


def test_account_level_leads_each_account(spark):
    rows = ledger.ledger_combined(mixed(spark), replace(P, levels=("account",))).collect()
    assert [(r.code, r.bold, r.partner) for r in rows] == [
        ("143501", True, None), ("143501", False, "Ana"), ("143501", False, "Bo"),
        ("613501", True, None), ("613501", False, "**"),
    ]


def test_account_and_partner_levels_combine(spark):
    rows = ledger.ledger_combined(mixed(spark), replace(P, levels=("account", "account_partner"))).collect()
    assert [(r.code, r.bold, r.partner) for r in rows][:5] == [
        ("143501", True, "Ana"), ("143501", True, "Bo"), ("143501", True, None),
        ("143501", False, "Ana"), ("143501", False, "Bo"),
    ]


def test_account_partner_level_sorts_by_partner(spark):
    rows = ledger.ledger_combined(mixed(spark), replace(P, levels=("account_partner",))).collect()
    assert [(r.partner, r.bold) for r in rows] == [
        ("**", True), ("**", False), ("Ana", True), ("Ana", False), ("Bo", True), ("Bo", False)
    ]


def test_partner_level_puts_subtotals_first(spark):
    rows = ledger.ledger_combined(mixed(spark), replace(P, levels=("partner",))).collect()
    assert [r.bold for r in rows] == [True, True, True, False, False, False]


def test_variant_adds_account_rows_and_dates_subtotals(spark):
    rows = ledger.ledger_combined_v2(mixed(spark), replace(P, levels=("account_partner",))).collect()
    assert [(r.code, r.partner, r.bold) for r in rows][:3] == [
        ("143501", None, True), ("143501", "Ana", True), ("143501", "Ana", False)
    ]
    assert {r.date for r in rows if r.bold} == {P.date_from}


def test_detail_with_balances_ignores_company_and_state(spark):
    t = erp(spark, [
        {"date": BEFORE, "debit": money(5), "company_id": 9, "parent_state": "draft", "partner_id": None},
        {"date": INSIDE, "debit": money(1), "partner_id": None},
    ])
    (row,) = ledger.ledger_detail_with_balances(t, P).collect()
    assert amounts(row) == (5, 1, 0, 6)


def test_partner_subtotals(spark):
    t = erp(spark, [
        {"date": BEFORE, "debit": money(5), "company_id": 9},
        {"date": INSIDE, "credit": money(2)},
        {"date": INSIDE, "debit": money(3), "partner_id": None},
    ])
    rows = {r.line: amounts(r) for r in ledger.partner_subtotals(t, P).collect()}
    assert rows == {"Total: Ana": (5, 0, 2, 3), "Total: **": (0, 3, 0, 3)}


def test_group_rollup_climbs_to_the_root(spark):
    t = erp(spark, [{"debit": money(1)}, {"debit": money(2), "account_id": 2}, {"debit": money(4), "account_id": 3}])
    rows = {(r.code, r.group): float(r.debit) for r in ledger.ledger_group_rollup(t, P).collect()}
    assert rows == {
        ("143501", False): 1, ("613501", False): 2, ("990000", False): 4,
        ("14", True): 1, ("1", True): 1, ("6", True): 2,
    }


def test_subtotals_balance_on_the_test_tables(star):
    p = replace(P, companies=(1, 2))
    for row in ledger.ledger_by_account(star, p).collect():
        assert row.initial + row.debit - row.credit == row.final


def test_preview_text(spark):
    t = erp(spark, [{"debit": money(1234567.5)}])
    (row,) = ledger.ledger_by_account_text(t, P).collect()
    assert row.debit == "1.234.567,50"


@pytest.mark.parametrize("levels", [("partner", "account"), ("nothing",)])
def test_levels_are_checked(levels):
    with pytest.raises(ValueError):
        replace(P, levels=levels)


def test_variant_takes_one_level(spark):
    with pytest.raises(ValueError):
        ledger.ledger_combined_v2(mixed(spark), replace(P, levels=("account", "account_partner")))

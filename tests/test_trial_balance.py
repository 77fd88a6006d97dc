from dataclasses import replace
from datetime import date

import pytest
from erp import erp, money

from folioflow import BalanceParams
from folioflow.operators import trial_balance as tb

P = BalanceParams(date(1998, 1, 1), date(1998, 12, 31), (1,))
BEFORE, INSIDE = date(1997, 6, 1), date(1998, 6, 1)


def amounts(row):
    return tuple(float(row[c]) for c in tb.AMOUNTS)


def test_opening_only_key_is_listed(spark):
    t = erp(spark, [{"date": BEFORE, "debit": money(10)}])
    (row,) = tb.trial_balance(t, P).collect()
    assert amounts(row) == (10, 0, 0, 10)


def test_movement_that_nets_to_zero_is_omitted(spark):
    t = erp(spark, [{"debit": money(3)}, {"credit": money(3)}])
    assert tb.trial_balance(t, P).count() == 0
    (row,) = tb.trial_balance(t, replace(P, omit_zero=False)).collect()
    assert amounts(row) == (0, 3, 3, 0)


def test_lines_of_the_other_book_make_keys_without_amounts(spark):
    t = erp(spark, [{"ifrs_type": "ifrs", "debit": money(3)}, {"ifrs_type": None, "debit": money(3), "account_id": 2}])
    assert tb.trial_balance(t, P).count() == 0
    rows = tb.trial_balance(t, replace(P, omit_zero=False)).collect()
    assert sorted((r.account_id, amounts(r)) for r in rows) == [(1, (0, 0, 0, 0)), (2, (0, 0, 0, 0))]


def test_first_day_is_inside(spark):
    t = erp(spark, [{"date": P.date_from, "debit": money(3)}, {"date": P.date_to, "debit": money(4)}])
    (row,) = tb.trial_balance(t, P).collect()
    assert amounts(row) == (0, 7, 0, 7)


def test_missing_partner_and_analytic_are_keys(spark):
    t = erp(spark, [
        {"partner_id": None, "date": BEFORE, "debit": money(1)},
        {"partner_id": None, "debit": money(2)},
        {"partner_id": 1, "analytic_account_id": 1, "debit": money(4)},
    ])
    rows = tb.trial_balance(t, replace(P, by_partner=True)).collect()
    assert sorted((str(r.partner), str(r.analytic_name), amounts(r)) for r in rows) == [
        ("Ana", "AN1", (0, 4, 0, 4)), ("None", "None", (1, 2, 0, 3))
    ]


def test_partner_filter_needs_partner_mode(spark):
    t = erp(spark, [{"debit": money(1)}, {"partner_id": 2, "debit": money(2)}])
    only = replace(P, partners=(2,))
    assert sum(r.debit for r in tb.trial_balance(t, only).collect()) == 3
    assert sum(r.debit for r in tb.trial_balance(t, replace(only, by_partner=True)).collect()) == 2


def test_levels_and_total(spark):
    t = erp(spark, [
        {"debit": money(1), "analytic_account_id": 1},
        {"debit": money(2)},
        {"debit": money(4), "account_id": 2},
        {"debit": money(8), "account_id": 3},
    ])
    rows = tb.trial_balance_levels(t, P).collect()
    assert [(r.code, r.bold, r.group, float(r.debit)) for r in rows] == [
        ("1", True, True, 3), ("14", True, True, 3),
        ("143501", True, False, 3), ("143501", False, False, 1), ("143501", False, False, 2),
        ("6", True, True, 4), ("613501", True, False, 4), ("613501", False, False, 4),
        ("990000", True, False, 8), ("990000", False, False, 8),
        (None, True, False, 15),
    ]
    assert rows[-1].name == "Total"
    assert {r.analytic_name for r in rows if r.bold and r.code} == {"/"}


def test_groups_of_nothing(spark):
    t = erp(spark, [{"debit": money(1)}])
    assert {r.code for r in tb.trial_balance_levels(t, P).collect() if r.group} == {"1", "14"}
    shown = tb.trial_balance_levels(t, replace(P, omit_zero=False)).collect()
    assert {r.code: float(r.debit) for r in shown if r.group} == {"1": 1, "14": 1, "6": 0}


def test_total_is_the_sum_of_the_rows(star):
    p = replace(P, companies=(1, 2))
    rows = tb.trial_balance_total(star, p).collect()
    assert rows[-1].name == "Total"
    for a in tb.AMOUNTS:
        assert sum(r[a] for r in rows[:-1]) == rows[-1][a]


def test_empty_ledger_has_a_zero_total(spark):
    (row,) = tb.trial_balance_total(erp(spark), P).collect()
    assert row.name == "Total" and amounts(row) == (0, 0, 0, 0)


def test_without_analytic(spark):
    t = erp(spark, [{"debit": money(1), "analytic_account_id": 1}, {"debit": money(2)}])
    report = tb.trial_balance_no_analytic(t, replace(P, by_analytic=False))
    assert "analytic_name" not in report.columns
    assert [float(r.debit) for r in report.collect()] == [3]
    with pytest.raises(ValueError):
        tb.trial_balance_no_analytic(t, P)

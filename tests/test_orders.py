"""The order of each ordered report against a sort of its rows written here, and the labels of its columns."""

from dataclasses import replace

import pytest

from folioflow.functions import headers
from folioflow.operators import inventory, journals, ledger, margin, purchases, sales, trial_balance
from folioflow.plans.catalogue import BALANCE, LEDGER, PERIOD, STOCK


def last(value):
    """Missing values after all others."""
    return (value is None, value if value is not None else 0)


def text(value):
    """Empty cells sort first."""
    return value or ""


def partner(r):
    return (r.partner == "**", r.partner)


def customer(r):
    """The partner's id, which its tax number carries."""
    return (r.vat is None, int(r.vat[1:]) if r.vat else 0)


def moment(r):
    return (r.date is not None, r.date)


TIES = (lambda r: (not r.bold,),)

ORDERED = {
    "ledger_detail": (lambda t: ledger.ledger_detail(t, LEDGER), lambda r: (r.date, r.move, partner(r))),
    "ledger_by_account": (lambda t: ledger.ledger_by_account(t, LEDGER), lambda r: r.code),
    "ledger_by_account_partner": (lambda t: ledger.ledger_by_account_partner(t, LEDGER), lambda r: (r.code, customer(r))),
    "ledger_by_partner": (lambda t: ledger.ledger_by_partner(t, LEDGER), lambda r: last(r.vat)),
    "combined_by_partner": (
        lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("partner",))),
        lambda r: (text(r.code), text(r.move), text(r.partner), not r.bold),
    ),
    "combined_by_account": (
        lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account", "account_partner"))),
        lambda r: (text(r.code), not r.bold),
    ),
    "combined_by_account_partner": (
        lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account_partner",))),
        lambda r: (text(r.partner), text(r.code), not r.bold),
    ),
    "combined_plain": (lambda t: ledger.ledger_combined(t, LEDGER), lambda r: (r.date, r.move, text(r.partner))),
    "detail_inside_a_block": (
        lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account",))),
        lambda r: (text(r.code), not r.bold, text(r.partner), moment(r), text(r.move)),
    ),
    "trial_balance": (lambda t: trial_balance.trial_balance(t, BALANCE), lambda r: r.code),
    "journal_audit": (lambda t: journals.journal_audit(t, PERIOD), lambda r: (r.move_id, r.date, r.account_id)),
    "stock_availability": (
        lambda t: inventory.stock_availability(t, STOCK), lambda r: (r.product_id, r.location_id, r.available_qty),
    ),
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order(star, name):
    report, key = ORDERED[name]
    keys = [key(r) for r in report(star).collect()]
    assert len(keys) > 3 and keys == sorted(keys)


def test_labels(star):
    plain = headers.headers(ledger.ledger_detail(star, LEDGER))
    full = headers.headers(ledger.ledger_detail(star, replace(LEDGER, with_analytic=True, with_currency=True)))
    assert list(full) == list(headers.LEDGER)
    assert list(plain) == [c for c in headers.LEDGER if c not in ("analytic", "currency", "amount")]
    assert list(headers.headers(trial_balance.trial_balance(star, BALANCE)).values())[0] == "Code"
    for report, labels in (
        (journals.journal_audit_labelled(star, PERIOD), headers.AUDIT),
        (purchases.purchase_lines_labelled(star, PERIOD), headers.PURCHASES),
        (sales.sales_lines_labelled(star, PERIOD), headers.SALES),
        (margin.product_margin_labelled(star, PERIOD), headers.MARGIN),
        (inventory.stock_availability_labelled(star, STOCK), headers.STOCK),
    ):
        assert headers.headers(report) == labels
        assert set(headers.shown_columns(report).columns) == set(labels.values())

"""Tax rules against a plain computation with exact fractions."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from erp import erp, money
from pyspark.sql import functions as F

from folioflow import Tables
from folioflow.operators.invoices import line_amounts_by_rules
from folioflow.operators.taxes import tax_rules

TAX = "id bigint, sequence int, amount_type string, amount decimal(9,4), price_include boolean, include_base_amount boolean, is_base_affected boolean"
TAXES = [
    (1, 10, "percent", "19", False, False, True), (2, 20, "percent", "5", True, False, True), (3, 5, "fixed", "0.75", False, True, True),
    (4, 6, "fixed", "1.1", True, True, True), (5, 30, "division", "8", False, False, True), (6, 7, "division", "12.5", True, True, True),
    (7, 1, "group", "0", False, False, True), (8, 2, "group", "0", False, False, True), (9, 8, "percent", "2.5", False, True, False),
    (10, 9, "percent", "10", True, True, True), (11, 4, "division", "100", False, False, True), (12, 3, "percent", "-2", False, False, None),
]
MEMBERS = [(7, 3), (7, 1), (8, 7), (8, 9)]


def step(x, by):
    """To a multiple, halves away from zero."""
    n = abs(x) / by
    n = int(n + Fraction(1, 2))
    return n * by * (1 if x >= 0 else -1)


def ordered(ids):
    """Taxes of a line with groups opened, in order."""
    by_id = {t[0]: t for t in TAXES}
    out = []
    for t in sorted((by_id[i] for i in ids), key=lambda t: (t[1], t[0])):
        out += ordered([c for p, c in MEMBERS if p == t[0]]) if t[2] == "group" else [t]
    return out


def plain(price, quantity, discount, ids, by):
    price, quantity, discount, by = map(Fraction, (price, quantity, discount, by))
    rest = 1 - discount / 100
    if not ids:
        total = step(price * quantity * rest, by)
        return total, Fraction(0), total
    rules = [(kind, Fraction(amount), inc, raises, raised is not False) for _, _, kind, amount, inc, raises, raised in ordered(ids)]
    gross = step(price * quantity, by)
    sign, base = (-1 if gross < 0 else 1), abs(gross)
    units = abs(quantity) if gross else quantity
    in_price = {"fixed": Fraction(0), "percent": Fraction(0), "division": Fraction(0)}
    marks, closes = {}, True

    def without(base):
        return (base - in_price["fixed"]) / (1 + in_price["percent"] / 100) * (100 - in_price["division"]) / 100

    for k in reversed(range(len(rules))):
        kind, amount, inc, raises, _ = rules[k]
        if raises:
            base, closes = without(base), True
            in_price = dict.fromkeys(in_price, Fraction(0))
        if inc:
            in_price[kind] += abs(units) * amount if kind == "fixed" else amount
            if closes:
                marks[k], closes = base, False
    excluded = step(without(base), by)
    base = included = excluded
    within = Fraction(0)
    for k, (kind, amount, inc, raises, raised) in enumerate(rules):
        own = base if inc or raised else excluded
        if k in marks:
            tax = marks[k] - base - within
        elif kind == "percent":
            tax = own * amount / 100
        elif kind == "fixed":
            tax = units * amount
        else:
            tax = own / (1 - amount / 100) - own if amount != 100 else Fraction(0)
        tax = step(tax, by)
        within = Fraction(0) if k in marks else within + tax if inc else within
        base += tax if raises else 0
        included += tax
    before, tax = sign * excluded * rest, sign * (included - excluded)
    return step(before, by), tax, step(before + tax, by)


def tables(spark, lines, bearing):
    others = {
        "account_tax_filiation_rel": ("parent_tax bigint, child_tax bigint", MEMBERS),
        "account_move_line_account_tax_rel": ("account_move_line_id bigint, account_tax_id bigint", bearing),
        "res_currency": ("id bigint, name string, rounding decimal(9,4)", [(1, "A", Decimal("0.01")), (2, "B", Decimal("0.05")), (3, "C", Decimal("1")), (4, "D", None)]),
        "account_tax": (TAX, [(*t[:3], Decimal(t[3]), *t[4:]) for t in TAXES]),
    }
    return erp(spark, lines, **others)


def test_random_lines(spark):
    pick = random.Random(8)
    lines, bearing, expected = [], [], {}
    steps = {1: "0.01", 2: "0.05", 3: "1", 4: "0.01", None: "0.01"}
    for k in range(1, 500):
        price, quantity = pick.choice(("0", "0.01", f"{pick.randrange(100000) / 100}", f"{-pick.randrange(5000) / 100}")), str(pick.choice((1, 2, 3.5, -2, 0)))
        discount, currency = str(pick.choice((0, 0, 10, 33))), pick.choice(list(steps))
        ids = pick.sample(range(1, 13), pick.choice((0, 1, 1, 2, 3, 4)))
        lines.append({"price_unit": money(price), "quantity": money(quantity), "discount": money(discount), "currency_id": currency})
        bearing += [(k, i) for i in ids]
        expected[k] = plain(price, quantity, discount, ids, steps[currency])
    got = {r.line_id: (Fraction(r.price_subtotal), Fraction(r.price_tax), Fraction(r.price_total)) for r in line_amounts_by_rules(tables(spark, lines, bearing)).collect()}
    assert {k: (got[k], expected[k]) for k in got if got[k] != expected[k]} == {}
    assert len(got) == 499


def test_price_with_tax_in_it_stays_the_price(spark):
    t = tables(spark, [{"price_unit": money(100), "quantity": money(3)}], [(1, 2)])
    (row,) = line_amounts_by_rules(t).collect()
    assert (row.price_subtotal, row.price_tax, row.price_total) == (Decimal("285.71"), Decimal("14.29"), Decimal("300.00"))


def test_groups_stand_where_they_are(spark):
    rules = {}
    for r in tax_rules(tables(spark, [{}], [])).orderBy("tax_id", "place").collect():
        rules.setdefault(r.tax_id, []).append((r.type, float(r.amount)))
    assert rules[7] == [("fixed", 0.75), ("percent", 19)]
    assert rules[8] == [("fixed", 0.75), ("percent", 19), ("percent", 2.5)]
    assert rules[1] == [("percent", 19)]


def test_groups_in_a_cycle_are_an_error(spark):
    t = tables(spark, [{}], [])
    looped = {n: t[n] for n in ("account_tax",)} | {"account_tax_filiation_rel": spark.createDataFrame([(7, 8), (8, 7)], "parent_tax bigint, child_tax bigint")}
    with pytest.raises(ValueError, match="cycle"):
        tax_rules(Tables.from_frames(looped))


def test_missing_numbers_are_zero(spark):
    t = tables(spark, [{"price_unit": None, "quantity": None, "discount": None}], [(1, 3)])
    t._opened["account_move_line"] = t["account_move_line"].withColumn("quantity", F.lit(None).cast("decimal(10,2)"))
    (row,) = line_amounts_by_rules(t).collect()
    assert (row.price_subtotal, row.price_tax, row.price_total) == (0, 0, 0)

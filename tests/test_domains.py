"""Searches against a plain evaluation, row by row, with missing values."""

import random

import pytest

from folioflow import Tables
from folioflow.functions.domains import search

PARTNERS = [(1, "Ana", "A1", None, 1), (2, "bob", None, 1, 2), (3, None, "C3", 2, None), (4, "Ana Maria", "D4", None, 9), (5, "ROB", "E5", 4, 2)]
CITIES = [(1, "Cali"), (2, "Bogota"), (3, None)]
OPPOSITE = {"=": "!=", "<": ">=", ">": "<=", "in": "not in", "like": "not like", "ilike": "not ilike", "child_of": "not child_of"}
OPPOSITE |= {b: a for a, b in OPPOSITE.items()}
PARTNER = {r[0]: dict(zip(("id", "name", "vat", "parent_id", "city_id"), r, strict=True)) for r in PARTNERS}
CITY = {r[0]: {"id": r[0], "name": r[1]} for r in CITIES}


def met(x, op, value):
    if op in ("!=", "not in", "not like", "not ilike"):
        return not met(x, OPPOSITE[op], value)
    if op == "=":
        return x is None if value is False else x is not None and x == value
    if op == "in":
        return x in value if x is not None else False in value
    if x is None:
        return False
    if op in ("like", "ilike"):
        return str(value) in x if op == "like" else str(value).lower() in x.lower()
    return {"<": x < value, ">": x > value, "<=": x <= value, ">=": x >= value}[op]


def under(n, roots):
    while n is not None and n in PARTNER:
        if n in roots:
            return True
        n = PARTNER[n]["parent_id"]
    return False


def leaf(row, path, op, value):
    head, *rest = path.split(".")
    if head in ("partner_id", "parent_id") and not rest and op.endswith("child_of"):
        return under(row[head], value) != op.startswith("not")
    if head in ("partner_id", "parent_id") and not rest and op.endswith("like"):
        p = PARTNER.get(row[head])
        plain = op.removeprefix("not ")
        return (p is not None and (met(p["name"], plain, value) or met(p["vat"], plain, value))) != op.startswith("not")
    if rest:
        table = CITY if head == "city_id" else PARTNER
        return row[head] in table and leaf(table[row[head]], ".".join(rest), op, value)
    return met(row[head], op, value)


def evaluated(domain, row):
    items = list(domain)

    def one(negated):
        item = items.pop(0)
        if item == "!":
            return one(not negated)
        if item in ("&", "|"):
            a, b = one(negated), one(negated)
            return (a and b) if (item == "&") != negated else (a or b)
        path, op, value = item
        return leaf(row, path, OPPOSITE[op] if negated else op, value)

    out = True
    while items:
        out = one(False) and out
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return Tables.from_frames(
        {
            "res_partner": spark.createDataFrame(PARTNERS, "id bigint, name string, vat string, parent_id bigint, city_id bigint"),
            "res_city": spark.createDataFrame(CITIES, "id bigint, name string"),
        }
    )


ROWS = [dict(zip(("n", "partner_id", "amount", "label"), r, strict=True)) for r in [(k, p, a, t) for k, (p, a, t) in enumerate(
    [(p, a, t) for p in (1, 2, 3, 4, 5, 99, None) for a, t in ((5, "x"), (None, "Xy"), (-3, None))])]]

LEAVES = [
    ("amount", "=", 5), ("amount", "!=", 5), ("amount", "<", 0), ("amount", ">=", 5), ("amount", "=", False), ("amount", "!=", False),
    ("amount", "in", (5, False)), ("amount", "not in", (5,)), ("label", "like", "x"), ("label", "ilike", "x"), ("label", "not ilike", "y"),
    ("partner_id", "child_of", (1,)), ("partner_id", "not child_of", (1, 4)), ("partner_id", "ilike", "ana"), ("partner_id", "not ilike", "b"),
    ("partner_id.name", "=", False), ("partner_id.name", "!=", "Ana"), ("partner_id.vat", "ilike", "3"), ("partner_id.city_id.name", "ilike", "bo"),
    ("partner_id.city_id.name", "=", False), ("partner_id.parent_id", "child_of", (1,)), ("partner_id.parent_id.name", "not ilike", "a"), ("partner_id", "=", 99),
]


def found(spark, tables, domain):
    rows = spark.createDataFrame([tuple(r.values()) for r in ROWS], "n int, partner_id bigint, amount int, label string")
    got = search(rows, tables, domain)
    assert got.columns == rows.columns
    return sorted(r.n for r in got.collect())


def test_single_conditions_and_their_opposites(spark, tables):
    for one in LEAVES:
        for domain in ([one], ["!", one]):
            assert found(spark, tables, domain) == [r["n"] for r in ROWS if evaluated(domain, r)], domain


def test_random_domains(spark, tables):
    pick = random.Random(2)

    def part(depth):
        kind = pick.choice(("&", "|", "!", "leaf")) if depth else "leaf"
        return [pick.choice(LEAVES)] if kind == "leaf" else ["!", *part(depth - 1)] if kind == "!" else [kind, *part(depth - 1), *part(depth - 1)]

    for _ in range(12):
        domain = [x for _ in range(pick.randint(1, 2)) for x in part(2)]
        assert found(spark, tables, domain) == [r["n"] for r in ROWS if evaluated(domain, r)], domain


def test_empty_and_wrong_domains(spark, tables):
    assert found(spark, tables, []) == [r["n"] for r in ROWS]
    for wrong in (["&", LEAVES[0]], ["!"], [("amount", "~", 1)], ["x"], [("amount.name", "=", 1)]):
        with pytest.raises(ValueError):
            found(spark, tables, wrong)

"""Search domains: conditions in prefix notation over a report and the tables its ids lead to.

A domain is a list of conditions ``(path, operator, value)`` with ``&``, ``|`` before the two and ``!`` before the one they
apply to; conditions that nothing joins are all required. A path may lead on over ids (``product_id.default_code``). Such
a condition is decided in the table it ends in, and comes back as the ids that meet it, so no name travels with the rows.

A condition is met or not, never unknown: a missing value meets ``!=`` and the ``not`` operators and no other, and
``False`` as a value stands for a missing one. ``!`` turns ``<`` into ``>=`` and so on, so a missing value meets neither.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .hierarchy import below
from .joins import lookup

Condition = tuple[str, str, object]
Domain = Sequence[str | Condition]

#: The table that an id leads to, and the paths by which its rows are searched as text.
RELATIONS: Mapping[str, str] = {
    "product_id": "product_product", "product_tmpl_id": "product_template", "partner_id": "res_partner", "parent_id": "res_partner",
    "categ_id": "product_category", "location_id": "stock_location", "lot_id": "stock_production_lot", "city_id": "res_city",
    "account_id": "account_account", "journal_id": "account_journal", "product_brand_id": "product_brand",
    "product_uom_id": "uom_uom", "analytic_account_id": "account_analytic_account", "sale_id": "sale_order", "company_id": "res_company",
}
SEARCHED: Mapping[str, tuple[str, ...]] = {
    "product_product": ("default_code", "product_tmpl_id.name"), "account_account": ("code", "name"), "res_partner": ("name", "vat"),
}

_OPPOSITE = {"=": "!=", "<": ">=", ">": "<=", "in": "not in", "like": "not like", "ilike": "not ilike", "child_of": "not child_of"}
_OPPOSITE |= {b: a for a, b in _OPPOSITE.items()}


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    operator: str
    value: object


@dataclass(frozen=True)
class Node:
    every: bool  # all of the parts, or any
    parts: tuple[Node | Leaf, ...]


def parsed(domain: Domain) -> Node:
    """The conditions as a tree; ``!`` is carried down to them."""
    items = iter(domain)

    def one(item: str | Condition, negated: bool) -> Node | Leaf:
        if item == "!":
            return one(_next(items), not negated)
        if item in ("&", "|"):
            return Node((item == "&") != negated, (one(_next(items), negated), one(_next(items), negated)))
        if isinstance(item, str) or len(item) != 3:
            raise ValueError(f"not a condition: {item!r}")
        path, operator, value = item
        if operator not in _OPPOSITE:
            raise ValueError(f"unknown operator {operator!r}")
        return Leaf(tuple(path.split(".")), _OPPOSITE[operator] if negated else operator, value)

    return Node(True, tuple(one(item, False) for item in items))


def _next(items: Iterator[str | Condition]) -> str | Condition:
    try:
        return next(items)
    except StopIteration:
        raise ValueError("an operator lacks its conditions") from None


def _values(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset, range)) else [value]


def _met(column: Column, operator: str, value: object) -> Column:
    """Whether a value meets a condition: true or false."""
    if operator in ("!=", "not in", "not like", "not ilike"):
        return ~_met(column, _OPPOSITE[operator], value)
    if operator == "=":
        found = column.isNull() if value is False or value is None else column == F.lit(value)
    elif operator == "in":
        known = [v for v in _values(value) if v is not False and v is not None]
        found = column.isin(*known) if known else F.lit(False)
        found = found | column.isNull() if len(known) < len(_values(value)) else found
    elif operator in ("like", "ilike"):
        found = column.like(f"%{value}%") if operator == "like" else column.ilike(f"%{value}%")
    else:
        found = {"<": column < F.lit(value), ">": column > F.lit(value), "<=": column <= F.lit(value), ">=": column >= F.lit(value)}[operator]
    return F.coalesce(found, F.lit(False))


def _leads_on(leaf: Leaf) -> bool:
    text = leaf.operator.removeprefix("not ") in ("like", "ilike") and leaf.path[0] in RELATIONS
    return len(leaf.path) > 1 or text or leaf.operator.endswith("child_of")


def _ids_of(tables: Tables, leaf: Leaf) -> DataFrame:
    """(found): the ids under the first field of a path whose rows meet the condition."""
    head, rest = leaf.path[0], leaf.path[1:]
    if head not in RELATIONS:
        raise ValueError(f"{head!r} leads to no table")
    table = RELATIONS[head]
    if not rest and leaf.operator.endswith("child_of"):
        return below(tables[table], _values(leaf.value)).select(F.col("id").alias("found"))
    if not rest:  # by the text of what the id stands for: any of its names
        parts = [_rows_of(tables, table, Leaf(tuple(p.split(".")), leaf.operator.removeprefix("not "), leaf.value)) for p in SEARCHED.get(table, ("name",))]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out.distinct()
    return _rows_of(tables, table, Leaf(rest, leaf.operator, leaf.value))


def _rows_of(tables: Tables, table: str, leaf: Leaf) -> DataFrame:
    """(found): the ids of a table's rows that meet a condition."""
    rows = tables[table]
    if not _leads_on(leaf):
        return rows.filter(_met(F.col(leaf.path[0]), leaf.operator, leaf.value)).select(F.col("id").alias("found"))
    inner = _ids_of(tables, leaf).withColumnRenamed("found", "_inner")
    how = "left_anti" if len(leaf.path) == 1 and leaf.operator.startswith("not ") else "left_semi"
    return rows.join(inner, rows[leaf.path[0]] == inner["_inner"], how).select(F.col("id").alias("found"))


def search(report: DataFrame, tables: Tables, domain: Domain) -> DataFrame:
    """The rows of a report that meet a domain; an empty domain is met by all."""
    rows, marks = report, 0
    spread = "_search_key"
    rows = rows.withColumn(spread, F.xxhash64(*[F.col(f"`{c}`") for c in report.columns]))

    def column(part: Node | Leaf) -> Column:
        nonlocal rows, marks
        if isinstance(part, Leaf):
            if not _leads_on(part):
                return _met(F.col(f"`{part.path[0]}`"), part.operator, part.value)
            mark, marks = f"_search_{marks}", marks + 1
            head = part.path[0]
            ids = _ids_of(tables, part).distinct().select(F.col("found").alias(head), F.lit(True).alias(mark))
            rows = lookup(rows, ids, head, spread)
            met = F.coalesce(F.col(mark), F.lit(False))
            return ~met if len(part.path) == 1 and part.operator.startswith("not ") else met
        out = F.lit(part.every)
        for inner in part.parts:
            out = out & column(inner) if part.every else out | column(inner)
        return out

    wanted = column(parsed(domain))
    return rows.filter(wanted).select(*[F.col(f"`{c}`") for c in report.columns])

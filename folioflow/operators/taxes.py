"""Taxes of the ledger lines: what each line bears, and amounts by the rules of the taxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import IVA_CODE
from ..sources.tables import Tables

RATE = "decimal(9,4)"


def line_taxes(tables: Tables, lines: DataFrame | None = None) -> DataFrame:
    """(line_id, tax_id, amount, description, is_iva) for every tax on a line, or on those with a ``line_id`` in ``lines``."""
    taxes = tables["account_tax"].select(
        F.col("id").alias("tax_id"), "amount", "description", "dian_tax_type_id"
    )
    types = tables["dian_tax_type"].select(F.col("id").alias("dian_tax_type_id"), "dian_code")
    known = taxes.join(types, "dian_tax_type_id", "left").select(
        "tax_id", F.col("amount").cast(RATE).alias("amount"), "description",
        F.coalesce(F.col("dian_code") == IVA_CODE, F.lit(False)).alias("is_iva"),
    )
    bearing = tables["account_move_line_account_tax_rel"].select(
        F.col("account_move_line_id").alias("line_id"), F.col("account_tax_id").alias("tax_id")
    )
    if lines is not None:
        bearing = bearing.join(lines, "line_id", "left_semi")
    return bearing.join(known, "tax_id")


def iva_by_line(tables: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Per line with taxes: the IVA tax of the lowest id with its rate, all IVA names and the summed rate.

    A line may carry several taxes in no given order, so the lowest id stands for "the" IVA.
    """
    iva = F.col("is_iva")
    return (
        line_taxes(tables, lines)
        .groupBy("line_id")
        .agg(
            F.min(F.when(iva, F.struct("tax_id", "amount"))).alias("first_iva"),
            F.expr(
                "listagg(CASE WHEN is_iva THEN description END, ';') "
                "WITHIN GROUP (ORDER BY tax_id)"
            ).alias("iva_names"),
            F.sum(F.when(iva, F.col("amount"))).cast(RATE).alias("iva_rate"),
        )
        .select(
            "line_id",
            F.col("first_iva.tax_id").alias("iva_tax_id"),
            F.col("first_iva.amount").alias("first_iva_rate"),
            "iva_names",
            "iva_rate",
            F.lit(True).alias("has_taxes"),
        )
    )


# -- amounts by tax rules ------------------------------------------------------------------------------

#: Amounts between the steps of a computation, of ten decimals; a division is rounded to them.
AMOUNT = "decimal(28,10)"
_STEP = "0.01"
_RULE = "type string, amount decimal(9,4), included boolean, raises boolean, raised boolean"
_MAX_NESTING = 32


def tax_rules(tables: Tables) -> DataFrame:
    """(tax_id, place, type, amount, included, raises, raised): every tax, and in place of a group its members.

    ``place`` orders the rules of a line: by sequence and id, and where a group stands by those of its members. Groups
    may be nested. ``included``: the price has the tax in it; ``raises``: the tax is part of the base of later ones;
    ``raised``: its base has such earlier taxes in it.
    """
    taxes = tables["account_tax"].select(
        "id", F.struct("sequence", "id").alias("at"), F.col("amount_type").alias("type"), F.col("amount").cast(RATE).alias("amount"),
        F.coalesce("price_include", F.lit(False)).alias("included"), F.coalesce("include_base_amount", F.lit(False)).alias("raises"),
        F.coalesce("is_base_affected", F.lit(True)).alias("raised"),
    )
    members = tables["account_tax_filiation_rel"].select(F.col("parent_tax").alias("id"), F.col("child_tax").alias("member"))
    # Members by the group they are in, however deep; taxes are a short table of settings.
    rows = taxes.select(F.col("id").alias("tax_id"), F.array("at").alias("place"), *taxes.columns)
    done, open_ = rows.filter("type <> 'group'"), rows.filter("type = 'group'")
    for _ in range(_MAX_NESTING):
        if open_.isEmpty():
            return done.select("tax_id", "place", "type", "amount", "included", "raises", "raised")
        inner = open_.select("tax_id", "place", "id").join(members, "id").select("tax_id", "place", F.col("member").alias("id"))
        inner = inner.join(taxes, "id").withColumn("place", F.concat("place", F.array("at"))).select(*rows.columns)
        done, open_ = done.unionByName(inner.filter("type <> 'group'")), inner.filter("type = 'group'")
    raise ValueError(f"tax groups nested more than {_MAX_NESTING} deep, or in a cycle")


def _to_step(amount: Column, step: Column) -> Column:
    """An amount as a multiple of a currency's step, halves away from zero."""
    return (F.round(amount / step, 0) * step).cast(AMOUNT)


def _without(base: Column, fixed: Column, percent: Column, division: Column) -> Column:
    """What is left of a base once the taxes in it are taken out: fixed amounts, then rates of the rest."""
    hundred = F.lit(100).cast("decimal(3,0)")
    rest = ((base - fixed) / (1 + percent.cast("decimal(12,4)") / hundred)).cast(AMOUNT)
    return (rest * ((hundred - division.cast("decimal(12,4)")) / hundred).cast("decimal(9,6)")).cast(AMOUNT)


def with_tax_totals(lines: DataFrame, rules: Column, price_unit: Column, quantity: Column, step: Column) -> DataFrame:
    """Lines with ``excluded`` and ``included``, their amount without and with all taxes.

    ``rules`` is an array of the line's rules in order. Taxes in the price are first taken out of it, from the last rule
    to the first; a rule that raises the base closes what comes after it. Then every tax is added up from the first rule on, each
    rounded to the step: a percentage of its base, an amount per unit, or a share of base and tax together (division). The last
    included tax of a closed block is what the price leaves for it, so that rounding doesn't change the price.
    """
    zero, hundred = F.lit(0).cast(AMOUNT), F.lit(100).cast("decimal(3,0)")
    gross = _to_step((price_unit * quantity).cast(AMOUNT), step)
    negative = gross < 0
    base = F.abs(gross).cast(AMOUNT)
    units = F.when(gross != 0, F.abs(quantity)).otherwise(quantity).cast("decimal(18,4)")

    def back(s: Column, r: Column) -> Column:
        cut = F.when(r["raises"], _without(s["base"], s["fixed"], s["percent"], s["division"])).otherwise(s["base"]).cast(AMOUNT)
        kept = {k: F.when(r["raises"], F.lit(0)).otherwise(s[k]).cast(AMOUNT) for k in ("fixed", "percent", "division")}
        closes = s["closes"] | r["raises"]
        more = {
            "fixed": F.when(r["type"] == "fixed", F.abs(units) * r["amount"]),
            "percent": F.when(r["type"] == "percent", r["amount"]),
            "division": F.when(r["type"] == "division", r["amount"]),
        }
        sums = {k: (kept[k] + F.when(r["included"], F.coalesce(more[k].cast(AMOUNT), zero)).otherwise(zero)).cast(AMOUNT) for k in kept}
        mark = F.when(r["included"] & closes, cut).cast(AMOUNT)
        marked = F.struct(*[r[n].alias(n) for n in ("type", "amount", "included", "raises", "raised")], mark.alias("mark"))
        return F.struct(
            cut.alias("base"), *[sums[k].alias(k) for k in sums], (closes & ~r["included"]).alias("closes"),
            F.concat(F.array(marked), s["rules"]).alias("rules"),
        )

    marked_type = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _RULE.split(', '))}, mark:{AMOUNT}>>"
    start = F.struct(base.alias("base"), *[zero.alias(k) for k in ("fixed", "percent", "division")], F.lit(True).alias("closes"), F.array().cast(marked_type).alias("rules"))
    taken = F.aggregate(F.reverse(rules), start, back)
    excluded = _to_step(_without(taken["base"], taken["fixed"], taken["percent"], taken["division"]), step)

    rows = lines.withColumns({"_taken": taken, "_step": step, "_units": units, "_negative": negative})
    rows = rows.withColumns({"_excluded": excluded})

    def forward(s: Column, r: Column) -> Column:
        own = F.when(r["included"] | r["raised"], s["base"]).otherwise(F.col("_excluded"))
        share = 1 - r["amount"] / hundred
        tax = (
            F.when(r["mark"].isNotNull(), r["mark"] - s["base"] - s["within"])
            .when(r["type"] == "percent", own * r["amount"] / hundred)
            .when(r["type"] == "fixed", F.col("_units") * r["amount"])
            .when(share != 0, own / F.nullif(share, F.lit(0).cast("decimal(9,4)")) - own)
            .otherwise(zero)
        )
        tax = _to_step(tax.cast(AMOUNT), F.col("_step"))
        within = F.when(r["mark"].isNotNull(), zero).when(r["included"], s["within"] + tax).otherwise(s["within"])
        return F.struct(
            F.when(r["raises"], s["base"] + tax).otherwise(s["base"]).cast(AMOUNT).alias("base"),
            within.cast(AMOUNT).alias("within"), (s["included"] + tax).cast(AMOUNT).alias("included"),
        )

    begin = F.struct(F.col("_excluded").alias("base"), zero.alias("within"), F.col("_excluded").alias("included"))
    rows = rows.withColumn("_included", F.aggregate("_taken.rules", begin, forward, lambda s: s["included"]))
    sign = F.when(F.col("_negative"), -1).otherwise(1)
    rows = rows.withColumns({"excluded": (F.col("_excluded") * sign).cast(AMOUNT), "included": (F.col("_included") * sign).cast(AMOUNT)})
    return rows.drop("_taken", "_step", "_units", "_negative", "_excluded", "_included")


def rules_by_line(tables: Tables, bearing: str) -> DataFrame:
    """(line_id, rules): the rules of the taxes on each line, in order. A line has a few taxes."""
    borne = tables[bearing].select(F.col("account_move_line_id").alias("line_id"), F.col("account_tax_id").alias("tax_id"))
    rule = F.struct("place", "type", "amount", "included", "raises", "raised")
    # The same rule from two taxes, one of them a group, counts twice, as it does on the invoice.
    each = borne.join(tax_rules(tables), "tax_id").groupBy("line_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    kept = F.transform("rules", lambda r: F.struct(*[r[n].alias(n) for n in ("type", "amount", "included", "raises", "raised")]))
    return each.select("line_id", kept.alias("rules"))


def no_rules() -> Column:
    return F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _RULE.split(', '))}>>")


def currency_step(rounding: Column) -> Column:
    return F.coalesce(rounding.cast("decimal(9,4)"), F.lit(_STEP).cast("decimal(9,4)"))

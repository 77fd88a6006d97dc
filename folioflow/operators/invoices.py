"""Invoice detail, line amounts and the links between invoices and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_window
from ..functions.joins import lookup
from ..functions.money import line_subtotal, or_zero, percent, thousands_text
from ..params import InvoiceParams
from ..sources.tables import Tables
from .taxes import RATE, currency_step, line_taxes, no_rules, rules_by_line, with_tax_totals

_TAX_TOTALS = (
    "subtotals array<struct<name:string>>, "
    "groups_by_subtotal map<string, array<struct<tax_group_name:string, tax_group_amount:decimal(18,2)>>>"
)
_PAYMENTS = "content array<struct<name:string, amount:decimal(18,2)>>"


def _invoices(tables: Tables, p: InvoiceParams) -> DataFrame:
    """Posted invoices of the type whose invoicing moment falls on a day of the window."""
    moves = tables["account_move"].filter(
        (F.col("state") == "posted")
        & (F.col("move_type") == p.move_type)
        & in_window(F.col("fe_datetime_invoice").cast("date"), p.date_start, p.date_end)
    )
    journals = tables["account_journal"].select(
        F.col("id").alias("journal_id"), F.col("name").alias("journal")
    )
    if p.journal_names:
        journals = journals.filter(F.col("journal").isin(*p.journal_names))
    return moves.select(
        F.col("id").alias("move_id"), "name", "journal_id", "amount_untaxed", "amount_total"
    ).join(journals, "journal_id")


def invoice_detail(tables: Tables, p: InvoiceParams) -> DataFrame:
    """Per invoice: number, untaxed amount, IVA of its lines, total."""
    invoices = _invoices(tables, p)
    iva = line_taxes(tables).filter("is_iva").select("line_id", "amount")
    lines = tables["account_move_line"].select(F.col("id").alias("line_id"), "move_id", "price_subtotal")
    taxed = (
        lines.join(invoices.select("move_id"), "move_id", "left_semi")
        .join(iva, "line_id")
        .groupBy("move_id")
        .agg(F.sum(F.col("price_subtotal") * F.col("amount") * percent()).alias("iva"))
    )
    return invoices.join(taxed, "move_id", "left").select(
        "move_id", "journal", "name", "amount_untaxed", or_zero(F.col("iva")).alias("iva"), "amount_total"
    )


def invoice_journal_summary(tables: Tables, p: InvoiceParams) -> DataFrame:
    """Per journal: first and last invoice number in text order, and the total invoiced."""
    return (
        _invoices(tables, p)
        .groupBy("journal")
        .agg(
            F.min("name").alias("start_invoice_number"),
            F.max("name").alias("end_invoice_number"),
            F.sum("amount_total").alias("amount_total"),
        )
    )


def invoice_tax_groups(widgets: DataFrame) -> DataFrame:
    """Tax groups under the first subtotal of each invoice's tax totals JSON, an empty list without one."""
    totals = _parsed("tax_totals_json", _TAX_TOTALS)
    first = F.get(totals["subtotals"], F.lit(0))["name"]
    groups = F.try_element_at(totals["groups_by_subtotal"], first)
    return widgets.select(
        "move_id", F.coalesce(groups, F.array().cast(_array_of(_TAX_TOTALS))).alias("tax_groups")
    )


def invoice_payments(widgets: DataFrame) -> DataFrame:
    """Content of each invoice's payments JSON; ``false`` or a missing content is an empty list."""
    content = _parsed("invoice_payments_widget", _PAYMENTS)["content"]
    return widgets.select(
        "move_id", F.coalesce(content, F.array().cast(_array_of(_PAYMENTS))).alias("payments")
    )


def _parsed(column: str, schema: str) -> Column:
    """JSON of the invoice form: ``false``, ``null`` or nothing is no object, and what doesn't parse is an error."""
    none = F.trim(F.col(column)).isin("false", "null", "")
    return F.when(~none, F.from_json(column, schema, {"mode": "FAILFAST"}))


def _array_of(schema: str) -> str:
    """The last ``array<struct<...>>`` named in a schema text."""
    start = schema.rindex("array<struct<")
    return schema[start : schema.index(">>", start) + 2]


def line_amounts(tables: Tables) -> DataFrame:
    """Per line: subtotal after discount, tax and total.

    Tax is taken on the price before discount; amounts are rounded to the currency's two decimals.
    """
    rates = line_taxes(tables).groupBy("line_id").agg(F.sum("amount").cast(RATE).alias("rate"))
    gross = F.col("price_unit") * F.col("quantity")
    lines = tables["account_move_line"].select(
        F.col("id").alias("line_id"), "move_id", F.col("name").alias("line"), "product_id", "price_unit", "quantity",
        "discount",
    )
    return (
        lines.join(rates, "line_id", "left")
        .withColumns(
            {
                "price_subtotal": F.round(
                    line_subtotal(F.col("price_unit"), F.col("quantity"), F.col("discount")), 2
                ),
                "price_tax": F.round(or_zero(gross * F.col("rate") * percent()), 2),
            }
        )
        .select(
            "line_id", "move_id", "line", "product_id", "price_subtotal", "price_tax",
            (F.col("price_subtotal") + F.col("price_tax")).alias("price_total"),
        )
    )


def line_amounts_by_rules(tables: Tables, bearing: str = "account_move_line_account_tax_rel") -> DataFrame:
    """Per line: subtotal after discount, tax and total, by the rules of every kind of tax.

    Taxes may be a percentage, an amount per unit, a share of the amount with tax, or a group of taxes; be in the price or
    not; and raise the base of later ones. They are computed on the price before discount; the discount is taken off the
    amount without taxes. Amounts are rounded to the step of the line's currency, two decimals without one. ``bearing``
    names the table of a line's taxes; a NULL price or quantity is zero.
    """
    steps = tables["res_currency"].select(F.col("id").alias("currency_id"), "rounding")
    price, quantity = or_zero(F.col("price_unit")), or_zero(F.col("quantity"))
    lines = tables["account_move_line"].select(
        F.col("id").alias("line_id"), "move_id", F.col("name").alias("line"), "product_id", "currency_id",
        price.alias("price_unit"), quantity.alias("quantity"), or_zero(F.col("discount")).cast("decimal(9,4)").alias("discount"),
    )
    rows = lookup(lines, steps, "currency_id", "line_id").join(rules_by_line(tables, bearing), "line_id", "left")
    rows = rows.withColumns({"step": currency_step(F.col("rounding")), "rules": F.coalesce("rules", no_rules())})
    rows = with_tax_totals(rows, F.col("rules"), F.col("price_unit"), F.col("quantity"), F.col("step"))
    bare = F.size("rules") == 0
    before = F.when(bare, F.col("price_unit") * F.col("quantity")).otherwise(F.col("excluded"))
    kept = (before * (100 - F.col("discount")) * percent()).cast("decimal(28,10)")
    tax = F.col("included") - F.col("excluded")

    def money(amount: Column) -> Column:
        return (F.round(amount / F.col("step"), 0) * F.col("step")).cast("decimal(18,4)")

    return rows.select(
        "line_id", "move_id", "line", "product_id", money(kept).alias("price_subtotal"), tax.cast("decimal(18,4)").alias("price_tax"),
        money(kept + tax).alias("price_total"),
    )


def line_iva_rates(tables: Tables) -> DataFrame:
    """Per line: its IVA rates as printed on the invoice, in the order of the taxes."""
    rates = (
        line_taxes(tables)
        .filter("is_iva")
        .withColumn("rate", F.concat(thousands_text(F.col("amount")), F.lit(" %")))
        .groupBy("line_id")
        .agg(F.expr("listagg(rate, ' ') WITHIN GROUP (ORDER BY tax_id)").alias("iva_rates"))
    )
    lines = tables["account_move_line"].select(
        F.col("id").alias("line_id"), "move_id", F.col("name").alias("line"), "product_id"
    )
    return lines.join(rates, "line_id", "left").select(
        "line_id", "move_id", "line", "product_id", F.coalesce("iva_rates", F.lit("")).alias("iva_rates")
    )


def _sold(tables: Tables) -> DataFrame:
    """(invoice_line_id, order_id) for every order line an invoice line came from."""
    order_lines = tables["sale_order_line"].select(F.col("id").alias("order_line_id"), "order_id")
    return tables["sale_order_line_invoice_rel"].join(order_lines, "order_line_id").select(
        "invoice_line_id", "order_id"
    )


def order_links_lines(tables: Tables) -> DataFrame:
    """Per line: its sales order, the lowest of several, and its partner's tax number."""
    partners = tables["res_partner"].select(F.col("id").alias("partner_id"), F.col("vat").alias("partner_vat"))
    lines = tables["account_move_line"].select(
        F.col("id").alias("line_id"), "move_id", F.col("name").alias("line"), "product_id", "partner_id"
    )
    sold = _sold(tables).groupBy(F.col("invoice_line_id").alias("line_id")).agg(F.min("order_id").alias("order_sale_id"))
    return (
        lookup(lines.join(sold, "line_id", "left"), partners, "partner_id", "line_id")
        .select("line_id", "move_id", "line", "product_id", "order_sale_id", "partner_vat")
    )


def order_links(tables: Tables) -> DataFrame:
    """Per entry: the sales and purchase order its lines came from, the lowest of several."""
    lines = tables["account_move_line"].select("id", "move_id", "purchase_line_id")
    sold = _sold(tables).select(F.col("invoice_line_id").alias("id"), F.col("order_id").alias("sale_id"))
    bought = tables["purchase_order_line"].select(
        F.col("id").alias("purchase_line_id"), F.col("order_id").alias("order_purchase_id")
    )
    linked = (
        lookup(lines.join(sold, "id", "left"), bought, "purchase_line_id", "id")
        .groupBy("move_id")
        .agg(F.min("sale_id").alias("sale_id"), F.min("order_purchase_id").alias("order_purchase_id"))
    )
    return (
        tables["account_move"].select(F.col("id").alias("move_id"))
        .join(linked, "move_id", "left")
        .select("move_id", "sale_id", "order_purchase_id")
    )

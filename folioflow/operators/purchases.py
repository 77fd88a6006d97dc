"""Purchase invoice lines with IVA and inventory account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_window, keep_ids
from ..functions.headers import PURCHASES, with_headers
from ..functions.joins import lookup
from ..functions.labels import INVENTORY_PREFIX
from ..functions.money import discount_value, percent, signed
from ..params import PeriodParams
from ..sources.tables import Tables
from .taxes import iva_by_line

# The document types of a purchase.
PURCHASE_TYPES = ("in_invoice", "in_refund", "in_receipt")


def inventory_accounts(tables: Tables, products: DataFrame) -> DataFrame:
    """(product_id, account_inventory) of the ``products``: the lowest inventory account among the entries of its valuation.

    Entries are reduced to their lowest inventory account before they meet the layers, so each layer
    stays one row however busy its entry or its product is.
    """
    accounts = (
        tables["account_account"]
        .filter(F.col("code").startswith(INVENTORY_PREFIX))
        .select(F.col("id").alias("account_id"), "code")
    )
    by_entry = (
        tables["account_move_line"]
        .select("move_id", "account_id")
        .join(accounts, "account_id")
        .groupBy("move_id")
        .agg(F.min("code").alias("code"))
    )
    layers = tables["stock_valuation_layer"].select("product_id", F.col("account_move_id").alias("move_id"))
    layers = layers.join(products, "product_id", "left_semi")
    return layers.join(by_entry, "move_id").groupBy("product_id").agg(F.min("code").alias("account_inventory"))


def _invoices(tables: Tables, p: PeriodParams) -> DataFrame:
    """Posted purchase documents of the window."""
    moves = tables["account_move"].filter(
        F.col("move_type").isin(*PURCHASE_TYPES)
        & (F.col("state") == "posted")
        & in_window(F.col("invoice_date"), p.date_from, p.date_to)
    )
    return keep_ids(moves, "partner_id", p.partners)


def purchase_amounts(tables: Tables, p: PeriodParams, with_order: bool = False) -> DataFrame:
    """(invoice_date, invoice_id, amount_untaxed, amount_total) of ``purchase_lines``, and ``purchase_id`` if asked for.

    The same lines without what only names them: a line needs a product, and its document.
    """
    moves = _invoices(tables, p).select(
        F.col("id").alias("invoice_id"), "invoice_date", "order_purchase_id",
        signed(F.col("amount_total"), _is_refund()).alias("amount_total"),
    )
    if with_order:
        orders = tables["purchase_order"].select(F.col("id").alias("order_purchase_id"), F.col("id").alias("purchase_id"))
        moves = lookup(moves, orders, "order_purchase_id", "invoice_id")
    lines = tables["account_move_line"].select(F.col("move_id").alias("invoice_id"), "product_id", F.col("balance").alias("amount_untaxed"))
    products = tables["product_product"].select(F.col("id").alias("product_id"))
    rows = lines.join(moves.drop("order_purchase_id"), "invoice_id").join(products, "product_id", "left_semi")
    return rows.drop("product_id")


def _purchases(tables: Tables, p: PeriodParams) -> DataFrame:
    """Product lines of posted purchase documents, with their header, product and inventory account.

    Partner and order belong to the header, template and inventory account to the product; they are
    joined there, so the lines themselves move only for their header, product and taxes.
    """
    moves = _invoices(tables, p).select(
        F.col("id").alias("move_id"), "invoice_date", F.col("partner_id").alias("invoice_partner_id"),
        F.col("name").alias("invoice"), "ref", F.col("journal_id").alias("invoice_journal_id"),
        "amount_total", "move_type", "order_purchase_id",
    )
    lines = tables["account_move_line"].select(
        "id", "move_id", "product_id", "account_id", "journal_id", "balance", "discount", "price_unit", "quantity"
    )
    templates = tables["product_template"].select(
        F.col("id").alias("product_tmpl_id"), "default_code", F.col("name").alias("product"),
        F.col("detailed_type").alias("product_type"),
    )
    partners = tables["res_partner"].select(
        F.col("id").alias("invoice_partner_id"), "vat", F.col("name").alias("partner")
    )
    orders = tables["purchase_order"].select(
        F.col("id").alias("order_purchase_id"), F.col("id").alias("purchase_id"), F.col("name").alias("purchase")
    )
    headers = lookup(moves.join(partners, "invoice_partner_id", "left"), orders, "order_purchase_id", "move_id")
    # Taxes and valuations of all time are cut down to the chosen lines before they are grouped.
    chosen = lines.select("id", "move_id", "product_id").join(moves.select("move_id"), "move_id", "left_semi")
    products = (
        tables["product_product"]
        .select(F.col("id").alias("product_id"), "product_tmpl_id")
        .join(templates, "product_tmpl_id", "left")
        .join(inventory_accounts(tables, chosen.select("product_id")), "product_id", "left")
    )
    return (
        lines.join(headers, "move_id")
        .join(products, "product_id")
        .join(iva_by_line(tables, chosen.select(F.col("id").alias("line_id"))).withColumnRenamed("line_id", "id"), "id", "left")
    )


def _is_refund() -> Column:
    return F.col("move_type") == "in_refund"


def _discount() -> Column:
    return discount_value(F.col("price_unit"), F.col("quantity"), F.col("discount"))


def _iva(rate: str) -> Column:
    return F.col(rate) * F.col("quantity") * F.col("price_unit") * percent()


def purchase_lines(tables: Tables, p: PeriodParams) -> DataFrame:
    """One row per line of posted purchase documents in the window.

    Refunds turn the sign of IVA and of the header total, which stands on every line of its invoice. The
    partner filter goes by the invoice's partner.
    """
    return _purchases(tables, p).select(
        "invoice_date",
        F.col("vat").alias("partner_vat"),
        F.col("invoice_partner_id").alias("partner_id"),
        "purchase_id",
        F.col("move_id").alias("invoice_id"),
        F.col("ref").alias("ref_invoice"),
        F.col("invoice_journal_id").alias("journal_id"),
        "default_code",
        "product_id",
        "account_id",
        "account_inventory",
        F.col("balance").alias("amount_untaxed"),
        _discount().alias("discount"),
        F.col("iva_tax_id").alias("tax_id"),
        signed(_iva("first_iva_rate"), _is_refund()).alias("value_tax"),
        signed(F.col("amount_total"), _is_refund()).alias("amount_total"),
        "move_type",
        "product_type",
    )


def purchase_lines_labelled(tables: Tables, p: PeriodParams) -> DataFrame:
    """The same lines with names; IVA names joined by ``;`` and IVA values that keep their sign.

    A line with taxes but no IVA has an empty tax text, a line without taxes none.
    """
    journals = tables["account_journal"].select(
        F.col("id").alias("journal_id"), F.col("name").alias("journal")
    )
    accounts = tables["account_account"].select(F.col("id").alias("account_id"), F.col("code").alias("account"))
    has_taxes = F.col("has_taxes").isNotNull()
    rows = _purchases(tables, p).join(journals, "journal_id", "left").join(accounts, "account_id", "left")
    rows = rows.select(
        "vat",
        "partner",
        "purchase",
        "invoice_date",
        "invoice",
        "ref",
        "journal",
        "default_code",
        "product",
        "account",
        "account_inventory",
        F.col("balance").alias("amount_untaxed"),
        _discount().alias("discount"),
        F.when(has_taxes, F.coalesce("iva_names", F.lit(""))).alias("tax"),
        _iva("iva_rate").alias("value_tax"),
        signed(F.col("amount_total"), _is_refund()).alias("amount_total"),
    )
    return with_headers(rows, PURCHASES)

"""Sales invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_window, keep_ids
from ..functions.headers import SALES, with_headers
from ..functions.joins import lookup
from ..functions.labels import sold_type_label
from ..functions.money import signed
from ..params import PeriodParams
from ..sources.tables import Tables

# The document types of a sale and the product types sold.
SALE_TYPES = ("out_invoice", "out_refund")
SOLD_PRODUCT_TYPES = ("product", "service")


def posted_sales(tables: Tables, p: PeriodParams) -> DataFrame:
    """Posted customer invoices and refunds in the window."""
    return tables["account_move"].filter(
        F.col("move_type").isin(*SALE_TYPES)
        & (F.col("state") == "posted")
        & in_window(F.col("invoice_date"), p.date_from, p.date_to)
    )


def _named(tables: Tables, table: str, key: str, name: str) -> DataFrame:
    return tables[table].select(F.col("id").alias(key), F.col("name").alias(name))


def _headers(tables: Tables, p: PeriodParams, by_order_partner: bool) -> DataFrame:
    """Invoices with their order; vat and city are those of the order's partner."""
    moves = posted_sales(tables, p)
    orders = tables["sale_order"].select(
        F.col("id").alias("sale_id"), F.col("id").alias("order_id"), F.col("name").alias("order"),
        F.col("partner_id").alias("order_partner_id"), "user_id", "team_id",
    )
    if by_order_partner:
        orders = keep_ids(orders, "order_partner_id", p.partners)
        kind = "inner" if isinstance(p.partners, DataFrame) or p.partners else "left"
    else:
        moves, kind = keep_ids(moves, "partner_id", p.partners), "left"
    partners = tables["res_partner"].select(
        F.col("id").alias("order_partner_id"), "vat", F.col("name").alias("partner"),
        F.col("city_id").alias("partner_city_id"),
    )
    moves = moves.select(
        F.col("id").alias("move_id"), F.col("name").alias("invoice"), "invoice_date", "move_type", "sale_id",
        F.col("partner_id").alias("invoice_partner_id"), "invoice_user_id", "city_id",
    )
    headers = moves.join(orders, "sale_id") if kind == "inner" else lookup(moves, orders, "sale_id", "move_id")
    return lookup(headers, partners, "order_partner_id", "move_id")


def _products(tables: Tables) -> DataFrame:
    """Variants of the templates that are sold."""
    templates = (
        tables["product_template"]
        .filter(F.col("detailed_type").isin(*SOLD_PRODUCT_TYPES))
        .select(
            F.col("id").alias("product_tmpl_id"), "default_code", F.col("name").alias("product"), "categ_id",
            "product_brand_id", "uom_id", "detailed_type",
        )
    )
    variants = tables["product_product"].select(F.col("id").alias("product_id"), "product_tmpl_id")
    return variants.join(templates, "product_tmpl_id")


def _sold_lines(tables: Tables, headers: DataFrame, products: DataFrame) -> DataFrame:
    """Lines meet headers and products that carry all their own names already."""
    lines = tables["account_move_line"].select(
        "move_id", "product_id", "analytic_account_id", "quantity", "balance"
    )
    return lines.join(headers, "move_id").join(products, "product_id")


def _quantity() -> Column:
    return signed(F.col("quantity"), F.col("move_type") == "out_refund")


def sales_lines(tables: Tables, p: PeriodParams) -> DataFrame:
    """One row per sold line; refunds turn the quantity, the subtotal is the balance turned round.

    vat and city are NULL for an invoice without an order. The partner filter goes by the invoice's
    partner.
    """
    rows = _sold_lines(tables, _headers(tables, p, by_order_partner=False), _products(tables))
    return rows.select(
        "invoice_date",
        F.col("order_id").alias("sale_id"),
        "move_id",
        "analytic_account_id",
        "product_id",
        "default_code",
        "categ_id",
        "product_brand_id",
        F.col("uom_id").alias("product_uom_id"),
        _quantity().alias("quantity"),
        (-F.col("balance")).alias("price_subtotal"),
        F.col("vat").alias("partner_vat"),
        F.col("invoice_partner_id").alias("partner_id"),
        F.col("partner_city_id").alias("city_partner_id"),
        "invoice_user_id",
        "move_type",
        F.col("detailed_type").alias("product_type"),
    )


def sales_lines_labelled(tables: Tables, p: PeriodParams) -> DataFrame:
    """The same lines with names. The partner filter goes by the order's partner."""
    sellers = tables["res_users"].select(
        F.col("id").alias("user_id"), F.col("partner_id").alias("seller_partner_id")
    ).join(_named(tables, "res_partner", "seller_partner_id", "seller"), "seller_partner_id", "left")
    headers = (
        _headers(tables, p, by_order_partner=True)
        .join(_named(tables, "res_city", "partner_city_id", "customer_city"), "partner_city_id", "left")
        .join(_named(tables, "res_city", "city_id", "invoice_city"), "city_id", "left")
        .join(_named(tables, "crm_team", "team_id", "team"), "team_id", "left")
    )
    headers = lookup(headers, sellers, "user_id", "move_id")
    products = (
        _products(tables)
        .join(_named(tables, "product_category", "categ_id", "category"), "categ_id", "left")
        .join(_named(tables, "product_brand", "product_brand_id", "brand"), "product_brand_id", "left")
        .join(_named(tables, "uom_uom", "uom_id", "unit"), "uom_id", "left")
    )
    analytics = _named(tables, "account_analytic_account", "analytic_account_id", "analytic")
    rows = lookup(_sold_lines(tables, headers, products), analytics, "analytic_account_id", "move_id")
    rows = rows.select(
        "invoice_date",
        "order",
        "invoice",
        "analytic",
        "default_code",
        "product",
        sold_type_label(F.col("detailed_type")).alias("product_type"),
        "category",
        "brand",
        "unit",
        _quantity().alias("total_quantity"),
        (-F.col("balance")).alias("total_price_subtotal"),
        "vat",
        "partner",
        "customer_city",
        "invoice_city",
        "seller",
        "team",
    )
    return with_headers(rows, SALES)

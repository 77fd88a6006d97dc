"""Product margin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_window, keep_ids
from ..functions.headers import MARGIN, with_headers
from ..functions.labels import COST_PREFIX
from ..functions.money import ratio, signed
from ..params import PeriodParams
from ..sources.tables import Tables
from .sales import posted_sales


def product_costs(tables: Tables, p: PeriodParams) -> DataFrame:
    """(product_id, cost): cost lines in the window on entries that carry valuation layers.

    A line counts once per layer of its entry, whatever the product of the layer. Layers are counted per
    entry first, so the line is multiplied instead of repeated.
    """
    accounts = (
        tables["account_account"]
        .filter(F.col("code").startswith(COST_PREFIX))
        .select(F.col("id").alias("account_id"))
    )
    lines = (
        tables["account_move_line"]
        .filter(in_window(F.col("date"), p.date_from, p.date_to))
        .select("move_id", "account_id", "product_id", "debit", "credit")
        .join(accounts, "account_id", "left_semi")
    )
    layers = (
        tables["stock_valuation_layer"]
        .groupBy(F.col("account_move_id").alias("move_id"))
        .agg(F.count(F.lit(1)).alias("layers"))
    )
    return (
        lines.join(layers, "move_id")
        .groupBy("product_id")
        .agg(
            (F.sum(F.col("debit") * F.col("layers")) - F.sum(F.col("credit") * F.col("layers"))).alias("cost")
        )
    )


def _sold(tables: Tables, p: PeriodParams) -> DataFrame:
    """Per storable product: template, quantity and subtotal with refunds taken off, and cost."""
    templates = keep_ids(
        tables["product_template"].filter(F.col("detailed_type") == "product"), "product_brand_id", p.brands
    ).select(
        F.col("id").alias("product_tmpl_id"), "default_code", "product_brand_id", F.col("name").alias("product")
    )
    products = tables["product_product"].select(F.col("id").alias("product_id"), "product_tmpl_id")
    moves = posted_sales(tables, p).select(F.col("id").alias("move_id"), "move_type")
    lines = keep_ids(tables["account_move_line"], "product_id", p.products).select(
        "move_id", "product_id", "quantity", "price_subtotal"
    )
    refund = F.col("move_type") != "out_invoice"
    return (
        lines.join(moves, "move_id")
        .groupBy("product_id")
        .agg(
            F.sum(signed(F.col("quantity"), refund)).alias("quantity"),
            F.sum(signed(F.col("price_subtotal"), refund)).alias("price_subtotal"),
        )
        .join(products, "product_id")
        .join(templates, "product_tmpl_id")
        .join(product_costs(tables, p), "product_id", "left")
    )


def _with_margin(rows: DataFrame) -> DataFrame:
    """Utility and its two ratios; a product without cost has none of the three."""
    return rows.withColumn("utility", F.col("price_subtotal") - F.col("cost")).withColumns(
        {
            "percentage_uti": ratio(F.col("utility"), F.col("price_subtotal")),
            "percentage_renta": ratio(F.col("utility"), F.col("cost")),
        }
    )


_MARGIN = ("quantity", "price_subtotal", "cost", "utility", "percentage_uti", "percentage_renta")


def product_margin(tables: Tables, p: PeriodParams) -> DataFrame:
    """Per product: quantity, subtotal, cost, utility, utility / subtotal and utility / cost."""
    return _with_margin(_sold(tables, p)).select("product_id", "default_code", "product_brand_id", *_MARGIN)


def product_margin_labelled(tables: Tables, p: PeriodParams) -> DataFrame:
    """The same keyed by product name, code, brand name and cost: variants of equal cost merge."""
    brands = tables["product_brand"].select(
        F.col("id").alias("product_brand_id"), F.col("name").alias("brand")
    )
    rows = (
        _sold(tables, p)
        .join(brands, "product_brand_id", "left")
        .groupBy("product", "default_code", "brand", "cost")
        .agg(F.sum("quantity").alias("quantity"), F.sum("price_subtotal").alias("price_subtotal"))
    )
    rows = _with_margin(rows).select("product", "default_code", "brand", *_MARGIN)
    return with_headers(rows, MARGIN)

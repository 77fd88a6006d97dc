"""Stock availability and inventory listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import between_moments, keep_ids
from ..functions.headers import STOCK, with_headers
from ..functions.joins import lookup
from ..functions.labels import code_and_name
from ..params import Ids, InventoryParams, StockParams
from ..sources.tables import Tables


def _quants(tables: Tables, p: StockParams) -> DataFrame:
    """Positive quants of storable products in internal locations."""
    quants = keep_ids(tables["stock_quant"], "product_id", p.products).filter("quantity > 0")
    locations = keep_ids(tables["stock_location"], "id", p.locations).filter(F.col("usage") == "internal")
    templates = keep_ids(tables["product_template"], "categ_id", p.categories).filter(
        F.col("detailed_type") == "product"
    )
    rows = (
        quants.join(
            tables["product_product"].select(
                F.col("id").alias("product_id"), "product_tmpl_id", F.col("default_code").alias("variant_code")
            ),
            "product_id",
        )
        .join(
            templates.select(
                F.col("id").alias("product_tmpl_id"), F.col("name").alias("product"), "product_brand_id",
                "categ_id", F.col("uom_id").alias("product_uom_id"),
            ),
            "product_tmpl_id",
        )
        .join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id")
    )
    if p.search:
        wanted = f"%{p.search}%"
        rows = rows.filter(F.col("variant_code").ilike(wanted) | F.col("product").ilike(wanted))
    return rows.withColumn("available_qty", F.col("quantity") - F.col("reserved_quantity"))


_STOCK = ("quantity", "reserved_quantity", "available_qty")


def stock_availability(tables: Tables, p: StockParams) -> DataFrame:
    """Distinct quants with what is left of them after reservations, by product, location and what is left."""
    rows = _quants(tables, p).select(
        "product_id", "product_brand_id", "location_id", "lot_id", *_STOCK, "categ_id", "product_uom_id"
    )
    return rows.distinct().orderBy("product_id", "location_id", "available_qty", F.asc_nulls_first("lot_id"), "quantity")


def product_labels(tables: Tables) -> DataFrame:
    """Products as lists name them: ``[code] name``, or the name alone."""
    templates = tables["product_template"].select(F.col("id").alias("product_tmpl_id"), "name")
    products = tables["product_product"].select(F.col("id").alias("product_id"), "product_tmpl_id", "default_code")
    return products.join(templates, "product_tmpl_id").select(
        "product_id", code_and_name(F.col("default_code"), F.col("name")).alias("label")
    )


def stock_availability_labelled(tables: Tables, p: StockParams) -> DataFrame:
    """The same with names; quants that read the same are listed once."""
    rows = _quants(tables, p)
    for table, key, name in (
        ("product_brand", "product_brand_id", "brand"),
        ("stock_production_lot", "lot_id", "lot"),
        ("product_category", "categ_id", "category"),
        ("uom_uom", "product_uom_id", "unit"),
    ):
        names = tables[table].select(F.col("id").alias(key), F.col("name").alias(name))
        rows = lookup(rows, names, key, "product_id")
    rows = rows.select(
        "product", F.col("variant_code").alias("default_code"), "brand", "location", "lot", "category", "unit", *_STOCK
    ).distinct()
    return with_headers(rows, STOCK)


def _companies(tables: Tables) -> DataFrame:
    return tables["res_company"].select(F.col("id").alias("company_id"), F.col("name").alias("company"))


def inventory_transfers(tables: Tables, p: InventoryParams) -> DataFrame:
    """Pickings with partner and company, by scheduled date."""
    partners = tables["res_partner"].select(F.col("id").alias("partner_id"), F.col("name").alias("partner"))
    return (
        lookup(
            between_moments(tables["stock_picking"], "scheduled_date", p.date_from, p.date_to), partners, "partner_id", "id"
        )
        .join(_companies(tables), "company_id", "left")
        .select(
            "id", "name", "partner_id", "scheduled_date", "origin", "company_id", "state", "partner", "company"
        )
    )


def inventory_categories(tables: Tables, p: InventoryParams) -> DataFrame:
    """Product x quant with property cost and category; the dates go by the template's creation.

    Every property of a product counts, so a product with several repeats its quants.
    """
    templates = between_moments(tables["product_template"], "create_date", p.date_from, p.date_to).select(
        F.col("id").alias("product_tmpl_id"), "name", "create_date", "categ_id"
    )
    products = tables["product_product"].select("id", "product_tmpl_id")
    quants = tables["stock_quant"].select(F.col("product_id").alias("id"), "quantity")
    costs = tables["ir_property"].select("res_id", "value_float")
    categories = tables["product_category"].select(F.col("id").alias("categ_id"), F.col("name").alias("category"))
    listed = (
        products.join(templates, "product_tmpl_id")
        .join(categories, "categ_id", "left")
        .withColumn("_key", F.concat(F.lit("product.product,"), F.col("id").cast("string")))
        .join(costs, F.col("res_id") == F.col("_key"), "left")
    )
    return quants.join(listed, "id").select(
        "res_id", "value_float", "name", "create_date", "categ_id", "id", "quantity", "category"
    )


def inventory_warehouses(tables: Tables, p: InventoryParams) -> DataFrame:
    """Warehouses with company, view location and the name of the reception route."""
    locations = tables["stock_location"].select(
        F.col("id").alias("view_location_id"), F.col("name").alias("location")
    )
    routes = tables["stock_location_route"].select(
        F.col("id").alias("reception_route_id"), F.col("name").alias("route")
    )
    return (
        between_moments(tables["stock_warehouse"], "write_date", p.date_from, p.date_to)
        .join(_companies(tables), "company_id", "left")
        .join(locations, "view_location_id", "left")
        .join(routes, "reception_route_id", "left")
        .select("name", "company_id", "view_location_id", "write_date", "company", "location", "route")
    )


def inventory_locations(tables: Tables, p: InventoryParams) -> DataFrame:
    """Locations with usage and company, by creation date."""
    return (
        between_moments(tables["stock_location"], "create_date", p.date_from, p.date_to)
        .join(_companies(tables), "company_id", "left")
        .select("complete_name", F.col("usage").alias("location_type"), "create_date", "company_id", "company")
    )


def sales_order_totals(tables: Tables) -> DataFrame:
    """Three rows: orders and their amount, order lines and their subtotal, products and theirs.

    The two totals over the lines come out of one pass.
    """
    by_order = tables["sale_order"].agg(
        F.lit("report_by_order").alias("report"), F.count("id").alias("orders"), F.sum("amount_total").alias("amount")
    )
    by_line = (
        tables["sale_order_line"]
        .agg(F.count("id").alias("lines"), F.count("product_id").alias("products"), F.sum("price_subtotal").alias("total"))
        .selectExpr(
            "inline(array(named_struct('report', 'report_by_order_detail', 'orders', lines, 'amount', total),"
            " named_struct('report', 'report_by_product', 'orders', products, 'amount', total)))"
        )
    )
    return by_order.unionByName(by_line)


def stock_on_hand_as_of(
    tables: Tables, as_of: datetime, products: Ids = (), templates: Ids = ()
) -> DataFrame:
    """Quantity of every storable product at a moment: its movements up to then, 0 without any.

    A product filter takes precedence over a template filter.
    """
    by_product = isinstance(products, DataFrame) or bool(products)
    catalogue = keep_ids(tables["product_product"], "id", products)
    if not by_product:
        catalogue = keep_ids(catalogue, "product_tmpl_id", templates)
    storable = tables["product_template"].filter(F.col("detailed_type") == "product").select(
        F.col("id").alias("product_tmpl_id"), F.col("name").alias("product")
    )
    moved = (
        between_moments(tables["stock_move_line"], "date", None, as_of)
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("quantity"))
    )
    return (
        catalogue.select(F.col("id").alias("product_id"), "product_tmpl_id", "default_code")
        .join(storable, "product_tmpl_id")
        .join(moved, "product_id", "left")
        .select(
            "product_id", "default_code", "product",
            F.coalesce("quantity", F.lit(0).cast("decimal(28,2)")).alias("qty_available"),
        )
    )

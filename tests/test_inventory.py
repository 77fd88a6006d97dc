from datetime import datetime
from decimal import Decimal as D

import pytest

from folioflow import InventoryParams, StockParams, Tables
from folioflow.operators import inventory, pivots

MONEY = "decimal(18,2)"


@pytest.fixture
def stock(spark):
    return Tables.from_frames(
        {
            "stock_quant": spark.createDataFrame(
                [
                    (1, 1, None, D(5), D(2)), (1, 1, None, D(5), D(2)), (1, 1, 7, D(5), D(2)), (2, 1, None, D(-1), D(0)),
                    (2, 2, None, D(9), D(0)), (3, 1, None, D(9), D(0)), (4, 1, None, D(1), D(1)),
                ],
                f"product_id bigint, location_id bigint, lot_id bigint, quantity {MONEY}, reserved_quantity {MONEY}",
            ),
            "product_product": spark.createDataFrame(
                [(1, 1, "AB-1"), (2, 1, "AB-2"), (3, 2, "S"), (4, 3, "Z")],
                "id bigint, product_tmpl_id bigint, default_code string",
            ),
            "product_template": spark.createDataFrame(
                [
                    (1, "Ring", 1, 1, 1, "product", datetime(2020, 1, 1)), (2, "Help", 1, 1, 1, "service", datetime(2021, 1, 1)),
                    (3, "ring two", 2, 2, 1, "product", datetime(2022, 1, 1)),
                ],
                "id bigint, name string, categ_id bigint, product_brand_id bigint, uom_id bigint, detailed_type string, "
                "create_date timestamp_ntz",
            ),
            "product_category": spark.createDataFrame([(1, "K1"), (2, "K2")], "id bigint, name string"),
            "product_brand": spark.createDataFrame([(1, "B1")], "id bigint, name string"),
            "uom_uom": spark.createDataFrame([(1, "Unit")], "id bigint, name string"),
            "stock_production_lot": spark.createDataFrame([(7, "LOT7")], "id bigint, name string"),
            "stock_location": spark.createDataFrame(
                [(1, "Shelf", "WH/Shelf", "internal", 1, datetime(2020, 5, 1)), (2, "Dock", "WH/Dock", "supplier", 9, None)],
                "id bigint, name string, complete_name string, usage string, company_id bigint, create_date timestamp_ntz",
            ),
            "res_company": spark.createDataFrame([(1, "One")], "id bigint, name string"),
            "res_partner": spark.createDataFrame([(1, "Ana")], "id bigint, name string"),
            "ir_property": spark.createDataFrame(
                [("product.product,1", 2.5), ("product.product,1", 3.5), ("product.product,12", 9.9)],
                "res_id string, value_float double",
            ),
            "stock_location_route": spark.createDataFrame([(1, "Direct")], "id bigint, name string"),
            "stock_warehouse": spark.createDataFrame(
                [(1, "W1", 1, 1, 1, datetime(2020, 1, 1)), (2, "W2", 9, 9, 9, datetime(2021, 1, 1))],
                "id bigint, name string, company_id bigint, view_location_id bigint, reception_route_id bigint, "
                "write_date timestamp_ntz",
            ),
            "stock_picking": spark.createDataFrame(
                [
                    (1, "OUT1", 1, datetime(2020, 1, 1, 10), "SO1", 1, "done"),
                    (2, "OUT2", None, datetime(2020, 1, 2, 10), "SO2", 9, "done"),
                ],
                "id bigint, name string, partner_id bigint, scheduled_date timestamp_ntz, origin string, company_id bigint, "
                "state string",
            ),
            "stock_move_line": spark.createDataFrame(
                [(1, datetime(2020, 1, 1), D(5)), (1, datetime(2020, 1, 2), D(-2)), (1, datetime(2020, 1, 3), D(9))],
                f"product_id bigint, date timestamp_ntz, quantity {MONEY}",
            ),
            "sale_order": spark.createDataFrame([(1, D(5)), (2, D(6))], f"id bigint, amount_total {MONEY}"),
            "sale_order_line": spark.createDataFrame(
                [(1, 1, D(2)), (2, None, D(3))], f"id bigint, product_id bigint, price_subtotal {MONEY}"
            ),
        }
    )


def test_distinct_positive_internal_storable(stock):
    rows = inventory.stock_availability(stock, StockParams()).collect()
    assert sorted((r.product_id, r.lot_id, float(r.available_qty)) for r in rows if r.lot_id) == [(1, 7, 3)]
    assert sorted((r.product_id, float(r.available_qty)) for r in rows) == [(1, 3), (1, 3), (4, 0)]


def test_labels(stock):
    rows = inventory.stock_availability_labelled(stock, StockParams()).collect()
    assert {(r.product, r.brand, r.lot, r.category) for r in rows} == {
        ("Ring", "B1", None, "K1"), ("Ring", "B1", "LOT7", "K1"), ("ring two", None, None, "K2")
    }


@pytest.mark.parametrize(
    "params, products",
    [
        (StockParams(products=(4,)), {4}), (StockParams(categories=(1,)), {1}), (StockParams(locations=(2,)), set()),
        (StockParams(search="ab-"), {1}), (StockParams(search="RING"), {1, 4}), (StockParams(search="ring t"), {4}),
    ],
)
def test_stock_filters(stock, params, products):
    assert {r.product_id for r in inventory.stock_availability(stock, params).collect()} == products


def test_each_property_repeats_the_quant(stock):
    rows = inventory.inventory_categories(stock, InventoryParams()).collect()
    assert sorted(r.value_float for r in rows if r.id == 1) == [2.5] * 3 + [3.5] * 3
    assert [r.value_float for r in rows if r.id == 2] == [None, None]
    later = inventory.inventory_categories(stock, InventoryParams(date_from=datetime(2022, 1, 1)))
    assert {r.id for r in later.collect()} == {4}


def test_open_and_closed_bounds(stock):
    def names(p):
        return [r.name for r in inventory.inventory_transfers(stock, p).orderBy("id").collect()]

    assert names(InventoryParams()) == ["OUT1", "OUT2"]
    assert names(InventoryParams(date_from=datetime(2020, 1, 2, 10))) == ["OUT2"]
    assert names(InventoryParams(date_to=datetime(2020, 1, 1, 10))) == ["OUT1"]


def test_missing_names_stay_empty(stock):
    rows = inventory.inventory_warehouses(stock, InventoryParams()).orderBy("name").collect()
    assert [(r.company, r.location, r.route) for r in rows] == [("One", "Shelf", "Direct"), (None, None, None)]
    rows = inventory.inventory_locations(stock, InventoryParams()).collect()
    assert {(r.complete_name, r.location_type, r.company) for r in rows} == {
        ("WH/Shelf", "internal", "One"), ("WH/Dock", "supplier", None)
    }


def test_sales_order_totals(stock):
    rows = {r.report: (r.orders, float(r.amount)) for r in inventory.sales_order_totals(stock).collect()}
    assert rows == {"report_by_order": (2, 11), "report_by_order_detail": (2, 5), "report_by_product": (1, 5)}


def test_stock_as_of(stock):
    def on_hand(**filters):
        rows = inventory.stock_on_hand_as_of(stock, datetime(2020, 1, 2), **filters).collect()
        return {r.product_id: float(r.qty_available) for r in rows}

    assert on_hand() == {1: 3, 2: 0, 4: 0}
    assert on_hand(templates=(3,)) == {4: 0}
    assert on_hand(products=(1,), templates=(3,)) == {1: 3}


def test_pivot_totals(stock):
    rows = pivots.stock_pivot(stock, StockParams(), "product_id").collect()
    assert {(r.product_id, r.total_product_id): float(r.quantity) for r in rows} == {
        (1, False): 10, (4, False): 1, (None, True): 11
    }

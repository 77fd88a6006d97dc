"""Purchases, sales, margin, invoices and the links to orders."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from erp import erp, money

from folioflow import InvoiceParams, PeriodParams
from folioflow.operators import invoices, margin, purchases, sales
from folioflow.operators.margin import product_costs

P = PeriodParams(date(1998, 1, 1), date(1998, 12, 31))
REL = "account_move_line_id bigint, account_tax_id bigint"
LAYERS = "product_id bigint, account_move_id bigint"


def trade(spark, lines, moves=None, rel=(), layers=(), **others):
    tables = {
        "account_move_line_account_tax_rel": (REL, list(rel)),
        "stock_valuation_layer": (LAYERS, list(layers)),
        "product_product": ("id bigint, product_tmpl_id bigint, default_code string", [(1, 1, "P1"), (2, 2, "P2"), (3, 1, "P1")]),
        "product_template": (
            "id bigint, name string, default_code string, categ_id bigint, product_brand_id bigint, uom_id bigint, "
            "detailed_type string",
            [(1, "Bolt", "P1", 1, 1, 1, "product"), (2, "Help", "P2", 1, 1, 1, "consu")],
        ),
        "purchase_order": ("id bigint, name string", [(7, "PO7")]),
        "sale_order": (
            "id bigint, name string, partner_id bigint, user_id bigint, team_id bigint", [(5, "SO5", 2, 1, 1)]
        ),
        "product_brand": ("id bigint, name string", [(1, "Brand")]),
        **others,
    }
    lines = [{"product_id": 1, **line} for line in lines]
    return erp(spark, lines, moves or [{"id": 1, "move_type": "in_invoice"}], **tables)


def test_refund_turns_the_iva_of_lines_but_not_of_the_labelled_report(spark):
    t = trade(
        spark,
        [{"price_unit": money(100), "quantity": money(2)}],
        [{"id": 1, "move_type": "in_refund", "amount_total": money(238)}],
        rel=[(1, 1)],
    )
    (row,) = purchases.purchase_lines(t, P).collect()
    assert (float(row.value_tax), float(row.amount_total), row.tax_id) == (-38, -238, 1)
    (row,) = purchases.purchase_lines_labelled(t, P).collect()
    assert (float(row.value_tax), float(row.amount_total), row.tax) == (38, -238, "IVA 19")


def test_iva_beside_withholding_and_several_iva(spark):
    t = trade(
        spark,
        [{"price_unit": money(100)}] * 4,
        rel=[(1, 20), (1, 1), (2, 20), (3, 2), (3, 1)],
    )
    rows = purchases.purchase_lines(t, P).collect()
    assert sorted((r.tax_id, r.value_tax and float(r.value_tax)) for r in rows if r.tax_id) == [(1, 19), (1, 19)]
    labelled = purchases.purchase_lines_labelled(t, P).collect()
    assert sorted((str(r.tax), r.value_tax and float(r.value_tax)) for r in labelled if r.value_tax) == [
        ("IVA 19", 19), ("IVA 19;IVA 5", 24)
    ]
    assert sorted(str(r.tax) for r in labelled if not r.value_tax) == ["", "None"]


def test_equal_purchase_lines_stay_apart(spark):
    t = trade(spark, [{"price_unit": money(100)}] * 3)
    assert purchases.purchase_lines(t, P).count() == 3


def test_discount_value(spark):
    t = trade(spark, [{"price_unit": money(100), "quantity": money(3), "discount": money(10)}, {"discount": money(0)}])
    assert sorted(str(r.discount and float(r.discount)) for r in purchases.purchase_lines(t, P).collect()) == ["30.0", "None"]


def test_inventory_account_is_the_lowest_of_the_valuation(spark):
    t = trade(
        spark,
        [{}, {"move_id": 9, "account_id": 1, "product_id": 2}, {"move_id": 9, "account_id": 2, "product_id": 2}],
        layers=[(1, 9), (1, 9)],
    )
    assert [r.account_inventory for r in purchases.purchase_lines(t, P).collect()] == ["143501"]


def test_purchases_by_partner_of_the_invoice(spark):
    t = trade(spark, [{"partner_id": 2}])
    assert purchases.purchase_lines(t, PeriodParams(P.date_from, P.date_to, partners=(1,))).count() == 1
    assert purchases.purchase_lines(t, PeriodParams(P.date_from, P.date_to, partners=(2,))).count() == 0


def test_sales_take_vat_from_the_order(spark):
    moves = [{"id": 1, "sale_id": 5}, {"id": 2, "move_type": "out_refund"}]
    lines = [
        {"quantity": money(2), "balance": money(-10)},
        {"quantity": money(2), "balance": money(10), "move_id": 2},
        {"product_id": 2},
    ]
    rows = sales.sales_lines(trade(spark, lines, moves), P).collect()
    assert sorted((r.partner_id, str(r.partner_vat), float(r.quantity), float(r.price_subtotal)) for r in rows) == [
        (1, "B2", 2, 10), (1, "None", -2, -10)
    ]


def test_sales_partner_filters(spark):
    moves = [{"id": 1, "sale_id": 5}, {"id": 2}]
    t = trade(
        spark, [{}, {"move_id": 2}], moves,
        res_users=("id bigint, partner_id bigint", [(1, 1)]), res_city=("id bigint, name string", [(1, "C")]),
        crm_team=("id bigint, name string", [(1, "T")]), product_category=("id bigint, name string", [(1, "K")]),
        uom_uom=("id bigint, name string", [(1, "U")]),
    )
    by_one, by_two = PeriodParams(P.date_from, P.date_to, partners=(1,)), PeriodParams(P.date_from, P.date_to, partners=(2,))
    assert (sales.sales_lines(t, by_one).count(), sales.sales_lines(t, by_two).count()) == (2, 0)
    assert sales.sales_lines_labelled(t, by_one).count() == 0
    (row,) = sales.sales_lines_labelled(t, by_two).collect()
    assert (row.order, row.seller, row.product_type, row.customer_city) == ("SO5", "Ana", "Almacenable", "C")


def test_product_without_cost_has_no_margin(spark):
    moves = [{"id": 1}, {"id": 2, "move_type": "out_refund"}]
    t = trade(spark, [{"price_subtotal": money(10)}, {"price_subtotal": money(4), "move_id": 2}], moves)
    (row,) = margin.product_margin(t, P).collect()
    assert float(row.price_subtotal) == 6 and float(row.quantity) == 0
    assert (row.cost, row.utility, row.percentage_uti, row.percentage_renta) == (None, None, None, None)


def cost_lines():
    return [
        {"price_subtotal": money(10)},
        {"account_id": 2, "debit": money(3), "move_id": 9},
        {"account_id": 2, "credit": money(1), "move_id": 9},
        {"account_id": 2, "debit": money(50), "move_id": 9, "date": date(1999, 1, 1)},
        {"account_id": 1, "debit": money(50), "move_id": 9},
    ]


def test_cost_counts_once_per_layer_of_the_entry(spark):
    moves = [{"id": 1}, {"id": 9, "move_type": "entry"}]
    (row,) = margin.product_margin(trade(spark, cost_lines(), moves, layers=[(1, 9)]), P).collect()
    assert (float(row.cost), float(row.utility)) == (2, 8)
    assert (row.percentage_uti, row.percentage_renta) == (pytest.approx(0.8), pytest.approx(4.0))
    doubled = trade(spark, cost_lines(), moves, layers=[(1, 9), (2, 9)])
    assert [float(r.cost) for r in product_costs(doubled, P).collect()] == [4]


def test_ratios_of_nothing_are_null(spark):
    moves = [{"id": 1}, {"id": 9, "move_type": "entry"}]
    lines = [{"price_subtotal": money(0)}, {"account_id": 2, "debit": money(3), "credit": money(3), "move_id": 9}]
    (row,) = margin.product_margin(trade(spark, lines, moves, layers=[(1, 9)]), P).collect()
    assert (float(row.utility), row.percentage_uti, row.percentage_renta) == (0, None, None)


def test_variants_of_one_name_and_cost_merge(spark):
    t = trade(spark, [{"price_subtotal": money(1)}, {"price_subtotal": money(2), "product_id": 3}], [{"id": 1}])
    assert margin.product_margin(t, P).count() == 2
    (row,) = margin.product_margin_labelled(t, P).collect()
    assert (row.product, row.brand, float(row.price_subtotal)) == ("Bolt", "Brand", 3)


def test_margin_filters(spark):
    t = trade(spark, [{"price_subtotal": money(1)}, {"product_id": 3}], [{"id": 1}])
    assert margin.product_margin(t, PeriodParams(P.date_from, P.date_to, products=(3,))).count() == 1
    assert margin.product_margin(t, PeriodParams(P.date_from, P.date_to, brands=(2,))).count() == 0


def test_invoice_detail_and_summary(spark):
    moment = datetime(1998, 12, 31, 23, 30)
    moves = [
        {"id": 1, "name": "F9", "fe_datetime_invoice": moment, "amount_total": money(1)},
        {"id": 2, "name": "F10", "fe_datetime_invoice": moment, "amount_total": money(2)},
        {"id": 3, "name": "F0", "fe_datetime_invoice": datetime(1999, 1, 1), "amount_total": money(4)},
        {"id": 4, "name": "F1", "fe_datetime_invoice": moment, "state": "draft"},
    ]
    t = trade(spark, [{"price_subtotal": money(100)}, {"price_subtotal": money(10)}], moves, rel=[(1, 1), (1, 20), (2, 2)])
    p = InvoiceParams(P.date_from, P.date_to)
    rows = {r.name: float(r.iva) for r in invoices.invoice_detail(t, p).collect()}
    assert rows == {"F9": 19.5, "F10": 0}
    (row,) = invoices.invoice_journal_summary(t, p).collect()
    assert (row.start_invoice_number, row.end_invoice_number, float(row.amount_total)) == ("F10", "F9", 3)
    other = InvoiceParams(P.date_from, P.date_to, journal_names=("GENERAL",))
    assert invoices.invoice_journal_summary(t, other).count() == 0


def test_tax_is_taken_before_the_discount(spark):
    t = trade(spark, [{"price_unit": money(100), "quantity": money(2), "discount": money(10)}, {"price_unit": money(7)}], rel=[(1, 1)])
    rows = sorted(tuple(float(r[c]) for c in ("price_subtotal", "price_tax", "price_total")) for r in invoices.line_amounts(t).collect())
    assert rows == [(7, 0, 7), (180, 38, 218)]


def test_iva_rates_as_text(spark):
    t = trade(spark, [{}, {}], rel=[(1, 2), (1, 1), (1, 20)])
    rows = {r.line_id: r.iva_rates for r in invoices.line_iva_rates(t).collect()}
    assert rows == {1: "19.00 % 5.00 %", 2: ""}


def test_widgets(spark):
    widgets = spark.createDataFrame(
        [
            (1, '{"subtotals":[{"name":"B"}],"groups_by_subtotal":{"A":[],"B":[{"tax_group_name":"IVA","tax_group_amount":2}]}}',
             '{"content":[{"name":"p","amount":3.5}]}'),
            (2, '{"subtotals":[],"groups_by_subtotal":{}}', "false"),
            (3, '{"subtotals":[{"name":"C"}],"groups_by_subtotal":{}}', '{"title":"t"}'),
        ],
        "move_id bigint, tax_totals_json string, invoice_payments_widget string",
    )
    groups = {r.move_id: [(g.tax_group_name, g.tax_group_amount) for g in r.tax_groups] for r in invoices.invoice_tax_groups(widgets).collect()}
    assert groups == {1: [("IVA", 2.0)], 2: [], 3: []}
    paid = {r.move_id: [(c.name, c.amount) for c in r.payments] for r in invoices.invoice_payments(widgets).collect()}
    assert paid == {1: [("p", 3.5)], 2: [], 3: []}


@pytest.mark.parametrize("text", ['{"content":[{"name":"p","amount":3.5', "[1,", "nonsense", '{"content":[{"name":"p","amount":"much"}]}'])
def test_broken_json_is_an_error(spark, text):
    widgets = spark.createDataFrame([(1, text, text)], "move_id bigint, tax_totals_json string, invoice_payments_widget string")
    with pytest.raises(Exception, match="(?i)malformed"):
        invoices.invoice_payments(widgets).collect()


def test_widget_money_is_exact(spark):
    widgets = spark.createDataFrame(
        [(1, '{"content":[{"name":"p","amount":1234567890123.45}]}'), (2, None), (3, " false "), (4, "null"), (5, "")],
        "move_id bigint, invoice_payments_widget string",
    )
    paid = {r.move_id: [c.amount for c in r.payments] for r in invoices.invoice_payments(widgets).collect()}
    assert paid == {1: [Decimal("1234567890123.45")], 2: [], 3: [], 4: [], 5: []}


def test_header_takes_the_lowest_order_of_its_lines(spark):
    others = {
        "sale_order_line": ("id bigint, order_id bigint", [(11, 6), (12, 5)]),
        "sale_order_line_invoice_rel": ("order_line_id bigint, invoice_line_id bigint", [(11, 1), (12, 1)]),
        "purchase_order_line": ("id bigint, order_id bigint", [(21, 7)]),
    }
    t = trade(spark, [{}, {}], [{"id": 1}, {"id": 2}], **others)
    t = type(t).from_frames({**t._opened, **{n: t[n] for n in ("account_move", "res_partner", *others)},
                             "account_move_line": t["account_move_line"].selectExpr("*", "IF(id = 2, 21L, NULL) AS purchase_line_id")})
    assert sorted(tuple(r) for r in invoices.order_links(t).collect() if r.move_id == 1) == [(1, 5, 7)]
    lines = {r.line_id: (r.order_sale_id, r.partner_vat) for r in invoices.order_links_lines(t).collect()}
    assert lines == {1: (5, "A1"), 2: (None, "A1")}


def test_sale_links_agree_with_the_headers(star):
    headers = {r.id: (r.sale_id, r.order_purchase_id) for r in star["account_move"].collect()}
    with_lines = {r.move_id for r in star["account_move_line"].select("move_id").distinct().collect()}
    for row in invoices.order_links(star).collect():
        if row.move_id in with_lines:
            assert (row.sale_id, row.order_purchase_id) == headers[row.move_id]
        else:
            assert (row.sale_id, row.order_purchase_id) == (None, None)


def test_decimal_input_keeps_cents(spark):
    t = trade(spark, [{"price_unit": money("0.10"), "quantity": money(3)}], rel=[(1, 1)])
    (row,) = invoices.line_amounts(t).collect()
    assert row.price_subtotal == Decimal("0.30") and row.price_tax == Decimal("0.06")

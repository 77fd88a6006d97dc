"""Every report by name, with the default parameters it is registered under."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import inventory, invoices, journals, ledger, margin, pivots, purchases, sales, trial_balance
from ..params import (
    BalanceParams,
    InventoryParams,
    InvoiceParams,
    JournalBookParams,
    LedgerParams,
    PeriodParams,
    StockParams,
)
from ..functions.domains import search
from ..functions.hierarchy import child_of
from ..session import prepare
from ..sources import StarTables, Tables
from ..sources.balances import BalanceCube, month_balances, with_cube

FROM, TO = date(1998, 1, 1), date(1998, 12, 31)
START, END = datetime(1998, 1, 1), datetime(1998, 12, 31, 23, 59, 59)
COMPANIES = (1, 2)
BRANCHES = ("FACTURA NORTE", "FACTURA CENTRO")

LEDGER = LedgerParams(FROM, TO, COMPANIES)
BALANCE = BalanceParams(FROM, TO, COMPANIES)
BOOK = JournalBookParams(FROM, TO)
PERIOD = PeriodParams(FROM, TO)
INVOICES = InvoiceParams(FROM, TO)
STOCK = StockParams()
ALWAYS = InventoryParams()
YEAR = InventoryParams(START, END)
# Windows that cut the dates of templates, and those of locations and warehouses.
TEMPLATES = InventoryParams(datetime(2000, 1, 11), datetime(2000, 2, 5, 12))
PLACES = InventoryParams(datetime(1995, 1, 3), datetime(1995, 1, 6, 12))

# A window that begins and ends inside a month, and the first month that isn't closed.
PART_FROM, PART_TO, OPEN = date(1998, 2, 10), date(1998, 11, 20), date(1998, 4, 1)
PART_LEDGER = LedgerParams(PART_FROM, PART_TO, COMPANIES)
PART_BALANCE = BalanceParams(PART_FROM, PART_TO, COMPANIES)

Report = Callable[[Tables], DataFrame]


def _tax_groups(t: Tables) -> DataFrame:
    groups = invoices.invoice_tax_groups(t["invoice_widgets"])
    return groups.select("move_id", F.posexplode_outer("tax_groups").alias("position", "g")).select(
        "move_id", "position", "g.tax_group_name", "g.tax_group_amount"
    )


def _payments(t: Tables) -> DataFrame:
    paid = invoices.invoice_payments(t["invoice_widgets"])
    return paid.select("move_id", F.posexplode_outer("payments").alias("position", "c")).select(
        "move_id", "position", "c.name", "c.amount"
    )


def _footers(t: Tables) -> DataFrame:
    return pivots.report_footers(
        {
            "purchase": (purchases.purchase_lines(t, PERIOD), ["amount_untaxed", "discount", "value_tax", "amount_total"]),
            "sales": (sales.sales_lines(t, PERIOD), ["quantity", "price_subtotal"]),
            "margin": (margin.product_margin(t, PERIOD), ["quantity", "price_subtotal", "cost", "utility"]),
            "journal": (journals.journal_audit(t, PERIOD), ["debit", "credit"]),
        }
    )


def _quarters(t: Tables) -> DataFrame:
    """Wide pivot: sellers down, quarters across."""
    report = sales.sales_lines(t, PERIOD).withColumn("quarter", F.concat(F.lit("q"), F.quarter("invoice_date")))
    return pivots.pivot_table(report, ["invoice_user_id"], "quarter", ["q1", "q2", "q3", "q4"], "price_subtotal")


def _partners_of(t: Tables, cities: range) -> DataFrame:
    return t["res_partner"].filter(F.col("city_id").isin(*cities)).select("id")


def _products_of(t: Tables, categories: range) -> DataFrame:
    templates = t["product_template"].filter(F.col("categ_id").isin(*categories)).select(F.col("id").alias("product_tmpl_id"))
    return t["product_product"].join(templates, "product_tmpl_id", "left_semi").select("id")


# Searches of the analysis screens: a product by its code or name; a customer and a category with all below them.
STOCK_SEARCH = ["|", ("product_id.default_code", "ilike", "p1"), ("product_id", "ilike", "ring")]
SALES_SEARCH = [
    ("partner_id", "child_of", range(0, 1000, 30)), "|", ("categ_id", "child_of", (1001, 1003)),
    "!", "|", ("product_id.product_tmpl_id.name", "ilike", "steel"), ("analytic_account_id", "=", False),
]


def _kept(t: Tables) -> Tables:
    """The tables with the balances of closed months beside them."""
    return with_cube(t, BalanceCube(month_balances(t["account_move_line"]), OPEN))


REPORTS: dict[str, Report] = {
    # ledger
    "ledger_detail": lambda t: ledger.ledger_detail(t, LEDGER),
    "ledger_detail_analytic_currency": lambda t: ledger.ledger_detail(
        t, replace(LEDGER, with_analytic=True, with_currency=True, posted_only=False, omit_zero=False)
    ),
    "ledger_by_account": lambda t: ledger.ledger_by_account(t, LEDGER),
    "ledger_detail_filtered": lambda t: ledger.ledger_detail(
        t, replace(LEDGER, accounts=(1, 2, 5), partners=_partners_of(t, range(0, 13)), analytics=(1, 2, 3))
    ),
    "ledger_by_account_ifrs": lambda t: ledger.ledger_by_account(t, replace(LEDGER, book="ifrs")),
    "ledger_by_account_text": lambda t: ledger.ledger_by_account_text(t, LEDGER),
    "ledger_by_account_partner": lambda t: ledger.ledger_by_account_partner(t, LEDGER),
    "ledger_by_partner": lambda t: ledger.ledger_by_partner(t, LEDGER),
    "ledger_combined": lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account", "account_partner"))),
    "ledger_combined_by_partner": lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("partner",))),
    "ledger_combined_plain": lambda t: ledger.ledger_combined(t, LEDGER),
    "ledger_combined_by_account_partner": lambda t: ledger.ledger_combined(t, replace(LEDGER, levels=("account_partner",))),
    "ledger_combined_v2": lambda t: ledger.ledger_combined_v2(t, replace(LEDGER, levels=("account_partner",))),
    "ledger_combined_v2_by_account": lambda t: ledger.ledger_combined_v2(t, replace(LEDGER, levels=("account",))),
    "ledger_combined_v2_by_partner": lambda t: ledger.ledger_combined_v2(t, replace(LEDGER, levels=("partner",))),
    "ledger_detail_with_balances": lambda t: ledger.ledger_detail_with_balances(t, LEDGER),
    "partner_subtotals": lambda t: ledger.partner_subtotals(t, LEDGER),
    "partner_subtotals_ifrs": lambda t: ledger.partner_subtotals(t, replace(LEDGER, book="ifrs")),
    "ledger_group_rollup": lambda t: ledger.ledger_group_rollup(t, LEDGER),
    "tax_ledger_order": lambda t: ledger.tax_ledger_order(t, LEDGER),
    "ledger_running_balance": lambda t: ledger.ledger_running_balance(t, LEDGER),
    # with balances of closed months
    "ledger_by_account_from_months": lambda t: ledger.ledger_by_account(_kept(t), PART_LEDGER),
    "ledger_by_account_partner_from_months": lambda t: ledger.ledger_by_account_partner(_kept(t), PART_LEDGER),
    "ledger_detail_with_balances_from_months": lambda t: ledger.ledger_detail_with_balances(_kept(t), PART_LEDGER),
    "partner_subtotals_from_months": lambda t: ledger.partner_subtotals(_kept(t), PART_LEDGER),
    "trial_balance_from_months": lambda t: trial_balance.trial_balance(_kept(t), PART_BALANCE),
    "trial_balance_by_partner_from_months": lambda t: trial_balance.trial_balance(_kept(t), replace(PART_BALANCE, by_partner=True)),
    # trial balance
    "trial_balance": lambda t: trial_balance.trial_balance(t, BALANCE),
    "trial_balance_ifrs": lambda t: trial_balance.trial_balance(t, replace(BALANCE, book="ifrs", omit_zero=False)),
    "trial_balance_by_partner": lambda t: trial_balance.trial_balance(t, replace(BALANCE, by_partner=True)),
    "trial_balance_levels": lambda t: trial_balance.trial_balance_levels(t, BALANCE),
    "trial_balance_levels_by_partner": lambda t: trial_balance.trial_balance_levels(t, replace(BALANCE, by_partner=True)),
    "trial_balance_total": lambda t: trial_balance.trial_balance_total(t, BALANCE),
    "trial_balance_no_analytic": lambda t: trial_balance.trial_balance_no_analytic(t, replace(BALANCE, by_analytic=False)),
    # journals
    "journal_audit": lambda t: journals.journal_audit(t, PERIOD),
    "journal_audit_labelled": lambda t: journals.journal_audit_labelled(t, PERIOD),
    "journal_audit_of_journals": lambda t: journals.journal_audit(t, replace(PERIOD, journals=(2, 5))),
    "journal_book_lines": lambda t: journals.journal_book_lines(t, BOOK),
    "journal_book_totals": lambda t: journals.journal_book_totals(t, replace(BOOK, target_move="posted")),
    "journal_book_totals_text": lambda t: journals.journal_book_totals_text(t, replace(BOOK, target_move="posted")),
    "journal_book_taxes": lambda t: journals.journal_book_taxes(t, BOOK),
    "journal_book_print_rows": lambda t: journals.journal_book_print_rows(t, BOOK),
    "journal_book_print_rows_by_entry": lambda t: journals.journal_book_print_rows(t, replace(BOOK, sort_by="move_name")),
    # purchases, sales, margin
    "purchase_lines": lambda t: purchases.purchase_lines(t, PERIOD),
    "purchase_lines_of_partners": lambda t: purchases.purchase_lines(t, replace(PERIOD, partners=_partners_of(t, range(5, 14)))),
    "purchase_lines_labelled": lambda t: purchases.purchase_lines_labelled(t, PERIOD),
    "sales_lines": lambda t: sales.sales_lines(t, PERIOD),
    "sales_lines_labelled": lambda t: sales.sales_lines_labelled(t, PERIOD),
    "sales_lines_child_of_category": lambda t: child_of(
        sales.sales_lines(t, PERIOD), "categ_id", t["product_category"], (1001, 1003)
    ),
    "sales_lines_child_of_partner": lambda t: child_of(
        sales.sales_lines(t, PERIOD), "partner_id", t["res_partner"], (0, 10, 20, 30, 45)
    ),
    "sales_lines_search": lambda t: search(sales.sales_lines(t, PERIOD), t, SALES_SEARCH),
    "product_margin": lambda t: margin.product_margin(t, PERIOD),
    "product_margin_labelled": lambda t: margin.product_margin_labelled(t, PERIOD),
    # stock and inventory
    "stock_availability": lambda t: inventory.stock_availability(t, STOCK),
    "product_labels": lambda t: inventory.product_labels(t),
    "stock_availability_labelled": lambda t: inventory.stock_availability_labelled(t, STOCK),
    "stock_availability_filtered": lambda t: inventory.stock_availability(
        t, StockParams(locations=t["stock_location"].filter("usage = 'internal'").select("id"), products=_products_of(t, range(10, 31)))
    ),
    "stock_availability_search": lambda t: inventory.stock_availability(t, StockParams(search="RING")),
    "stock_availability_domain": lambda t: search(inventory.stock_availability(t, STOCK), t, STOCK_SEARCH),
    "inventory_transfers": lambda t: inventory.inventory_transfers(t, YEAR),
    "inventory_categories": lambda t: inventory.inventory_categories(t, ALWAYS),
    "inventory_categories_year": lambda t: inventory.inventory_categories(t, TEMPLATES),
    "inventory_warehouses": lambda t: inventory.inventory_warehouses(t, ALWAYS),
    "inventory_warehouses_year": lambda t: inventory.inventory_warehouses(t, PLACES),
    "inventory_locations": lambda t: inventory.inventory_locations(t, ALWAYS),
    "inventory_locations_year": lambda t: inventory.inventory_locations(t, PLACES),
    "sales_order_totals": lambda t: inventory.sales_order_totals(t),
    "stock_on_hand_as_of": lambda t: inventory.stock_on_hand_as_of(t, END),
    # invoices
    "invoice_detail": lambda t: invoices.invoice_detail(t, INVOICES),
    "invoice_journal_summary": lambda t: invoices.invoice_journal_summary(t, replace(INVOICES, journal_names=BRANCHES)),
    "invoice_tax_groups": _tax_groups,
    "invoice_payments": _payments,
    "invoice_detail_refunds": lambda t: invoices.invoice_detail(t, replace(INVOICES, move_type="out_refund")),
    "invoice_detail_bills": lambda t: invoices.invoice_detail(t, replace(INVOICES, move_type="in_invoice")),
    "line_amounts": lambda t: invoices.line_amounts(t).drop("line_id"),
    "line_amounts_by_rules": lambda t: invoices.line_amounts_by_rules(t, "account_move_line_tax_mix_rel").drop("line_id"),
    "line_iva_rates": lambda t: invoices.line_iva_rates(t).drop("line_id"),
    "order_links": lambda t: invoices.order_links(t),
    "order_links_lines": lambda t: invoices.order_links_lines(t).drop("line_id"),
    # pivots
    "sales_pivot": lambda t: pivots.sales_pivot(t, PERIOD),
    "sales_pivot_by_seller": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "invoice_user_id"),
    "sales_pivot_by_product": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "product_id"),
    "sales_pivot_by_category": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "categ_id"),
    "sales_pivot_quarters": _quarters,
    "sales_pivot_by_brand": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "product_brand_id"),
    "sales_pivot_by_customer": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "partner_id"),
    "sales_pivot_by_analytic": lambda t: pivots.sales_pivot_by_month(t, PERIOD, "analytic_account_id"),
    "purchase_pivot": lambda t: pivots.purchase_pivot(t, PERIOD),
    "purchase_pivot_by_order": lambda t: pivots.purchase_pivot(t, PERIOD, "purchase_id"),
    "purchase_pivot_by_invoice": lambda t: pivots.purchase_pivot(t, PERIOD, "invoice_id"),
    "journal_pivot": lambda t: pivots.journal_pivot(t, PERIOD),
    "journal_pivot_totals": lambda t: pivots.journal_pivot_totals(t, PERIOD),
    "journal_pivot_by_entry": lambda t: pivots.journal_pivot_of_lines(t, PERIOD, "move_id"),
    "journal_pivot_by_partner": lambda t: pivots.journal_pivot_of_lines(t, PERIOD, "partner_id"),
    "margin_pivot": lambda t: pivots.margin_pivot(t, PERIOD),
    "margin_pivot_by_brand": lambda t: pivots.margin_pivot(t, PERIOD, "product_brand_id"),
    "stock_pivot": lambda t: pivots.stock_pivot(t, STOCK),
    "stock_pivot_by_product": lambda t: pivots.stock_pivot(t, STOCK, "product_id"),
    "stock_pivot_by_brand": lambda t: pivots.stock_pivot(t, STOCK, "product_brand_id"),
    "stock_pivot_by_category": lambda t: pivots.stock_pivot(t, STOCK, "categ_id"),
    "list_footers": _footers,
}

# Ratios and rates keep six decimals when shown, amounts two.
RATIOS = ("percentage_uti", "percentage_renta")


def shown(report: DataFrame) -> DataFrame:
    """A report as handed out: amounts as doubles of two decimals, dates and moments as ISO texts."""

    def cell(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if field.name in RATIOS:
            return f"round({name}, 6) AS {name}"
        if isinstance(field.dataType, T.DecimalType):
            return f"CAST(round({name}, 2) AS DOUBLE) AS {name}"
        if isinstance(field.dataType, T.DateType):
            return f"date_format({name}, 'yyyy-MM-dd') AS {name}"
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') AS {name}"
        return name

    return report.selectExpr(*[cell(f) for f in report.schema.fields])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered report over the tables under a folder, opened afresh."""
    return shown(REPORTS[name](StarTables(prepare(spark), sf_dir)))

"""Hand-made ledger tables for edge cases."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from folioflow import Tables

LINE_SCHEMA = (
    "id bigint, move_id bigint, account_id bigint, partner_id bigint, product_id bigint, date date, journal_id bigint, "
    "parent_state string, company_id bigint, analytic_account_id bigint, currency_id bigint, name string, "
    "debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), amount_currency decimal(18,2), "
    "ifrs_debit decimal(18,2), ifrs_credit decimal(18,2), ifrs_type string, quantity decimal(10,2), "
    "price_unit decimal(14,2), discount decimal(5,0), price_subtotal decimal(18,4), tax_line_id bigint"
)
MOVE_SCHEMA = (
    "id bigint, name string, ref string, date date, invoice_date date, fe_datetime_invoice timestamp_ntz, state string, "
    "move_type string, journal_id bigint, partner_id bigint, amount_untaxed decimal(18,2), amount_total decimal(18,2), "
    "sale_id bigint, order_purchase_id bigint, invoice_user_id bigint, city_id bigint"
)


def _rows(spark, schema, rows, defaults):
    names = [part.split()[0] for part in schema.replace("decimal(18,2)", "d").replace("decimal(10,2)", "d")
             .replace("decimal(14,2)", "d").replace("decimal(5,0)", "d").replace("decimal(18,4)", "d").split(", ")]
    data = []
    for row in rows:
        full = {**defaults, **row}
        data.append(tuple(Decimal(str(full[n])) if isinstance(full.get(n), (float, _Money)) else full.get(n) for n in names))
    return spark.createDataFrame(data, schema)


class _Money(float):
    pass


def money(value) -> float:
    return _Money(value)


def erp(spark, lines=(), moves=(), **others) -> Tables:
    """Ledger of two accounts, one journal and two partners; other tables by name as (schema, rows)."""
    line = {
        "move_id": 1, "account_id": 1, "partner_id": 1, "date": date(1998, 5, 1), "journal_id": 1,
        "parent_state": "posted", "company_id": 1, "name": "x", "debit": money(0), "credit": money(0),
        "balance": money(0), "ifrs_debit": money(0), "ifrs_credit": money(0), "ifrs_type": "both",
        "quantity": money(1), "price_unit": money(1), "discount": money(0), "price_subtotal": money(0),
    }
    move = {
        "name": "M1", "date": date(1998, 5, 1), "invoice_date": date(1998, 5, 1), "state": "posted",
        "move_type": "out_invoice", "journal_id": 1, "partner_id": 1, "amount_untaxed": money(0), "amount_total": money(0),
    }
    frames = {
        "account_move_line": _rows(
            spark, LINE_SCHEMA, [{"id": n, **row} for n, row in enumerate(lines, 1)], line
        ),
        "account_move": _rows(spark, MOVE_SCHEMA, moves or [{"id": 1}], move),
        "account_account": spark.createDataFrame(
            [(1, "143501", "Inventory", 1), (2, "613501", "Cost", 1), (3, "990000", "Outside", 3)],
            "id bigint, code string, name string, ifrs_account_id bigint",
        ),
        "account_group": spark.createDataFrame(
            [(1, "1", "Assets", 0), (2, "14", "Stock", 1), (3, "6", "Costs", 0)],
            "id bigint, code string, name string, parent_id bigint",
        ),
        "account_journal": spark.createDataFrame(
            [(1, "SALES", "sale"), (2, "GENERAL", "general"), (3, "BUYS", "purchase")],
            "id bigint, name string, type string",
        ),
        "account_analytic_account": spark.createDataFrame([(1, "AN1")], "id bigint, name string"),
        "res_partner": spark.createDataFrame(
            [(1, "Ana", "A1", 1), (2, "Bo", "B2", 1)], "id bigint, name string, vat string, city_id bigint"
        ),
        "res_currency": spark.createDataFrame([(1, "COP")], "id bigint, name string"),
        "account_tax": spark.createDataFrame(
            [(1, Decimal("19"), "IVA 19", 1), (2, Decimal("5"), "IVA 5", 1), (20, Decimal("2.5"), "RTE", 6)],
            "id bigint, amount decimal(9,4), description string, dian_tax_type_id bigint",
        ),
        "dian_tax_type": spark.createDataFrame([(1, "01"), (6, "06")], "id bigint, dian_code string"),
    }
    for name, (schema, rows) in others.items():
        frames[name] = spark.createDataFrame(rows, schema)
    return Tables.from_frames(frames)

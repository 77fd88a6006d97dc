"""Pivot analysis over the line reports: cells, their totals, saved groupings and list footers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import after_until, in_months, keep_ids
from ..params import PeriodParams, StockParams
from ..sources.tables import Tables
from .inventory import stock_availability
from .margin import product_margin
from .purchases import purchase_amounts
from .sales import sales_lines


def _sums(measures: Sequence[str]) -> list[Column]:
    return [F.sum(m).alias(m) for m in measures]


def pivot_cells(report: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Pivot in long form: one row per cell, plus row, column and grand totals.

    ``total_<key>`` tells a total from a key that is NULL. The report is summed to its cells first, so
    the totals are built from cells and a wide key never becomes columns.
    """
    cells = report.groupBy(*rows, *cols).agg(*_sums(measures))
    return _with_totals(cells, [[*rows, *cols], [*rows], [*cols], []], measures)


def pivot_groups(report: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Nested grouping: a row per key combination, a subtotal per leading keys and the grand total."""
    cells = report.groupBy(*keys).agg(*_sums(measures))
    return _with_totals(cells, [list(keys[:n]) for n in range(len(keys), -1, -1)], measures)


def _with_totals(cells: DataFrame, sets: list[list[str]], measures: Sequence[str]) -> DataFrame:
    """``cells`` summed over each of the grouping sets, the first of which has every key."""
    keys = sets[0]
    wanted = list(dict.fromkeys(tuple(s) for s in sets))
    return cells.groupingSets([[F.col(k) for k in s] for s in wanted], *[F.col(k) for k in keys]).agg(
        *[(F.grouping(k) == 1).alias(f"total_{k}") for k in keys], *_sums(measures)
    )


def pivot_table(
    report: DataFrame, rows: Sequence[str], col: str, values: Sequence, measure: str
) -> DataFrame:
    """Pivot in wide form for a known short list of column values."""
    return report.groupBy(*rows).pivot(col, list(values)).agg(F.sum(measure))


def pivot_distinct(report: DataFrame, rows: Sequence[str], cols: Sequence[str], key: str, name: str) -> DataFrame:
    """Number of different values of a whole-number ``key`` per cell, with row, column and grand totals in long form.

    Such numbers don't add up, so cells and totals are counted from the different values themselves: a task holds a share
    of the rows' cells and values, and nothing whose size depends on how far the values are apart. The report is read
    once; a NULL key isn't counted, and a cell with no other has none.
    """
    keys = [*rows, *cols]
    sets = list(dict.fromkeys(((*rows, *cols), (*rows,), (*cols,), ())))
    values = report.select(*keys, F.col(key).cast("long").alias("_value"))
    return values.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *[(F.grouping(k) == 1).alias(f"total_{k}") for k in keys], F.count_distinct("_value").alias(name)
    )


def list_totals(report: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Footer of a list: the sum of each measure."""
    return report.agg(*_sums(measures))


def month(column: str) -> Column:
    return F.date_trunc("month", column).cast("date")


def sales_pivot(tables: Tables, p: PeriodParams) -> DataFrame:
    """Invoice date x product: subtotal, with totals both ways."""
    return pivot_cells(sales_lines(tables, p), ["invoice_date"], ["product_id"], ["price_subtotal"])


def sales_pivot_by_month(tables: Tables, p: PeriodParams, key: str) -> DataFrame:
    """Saved groupings: month, then seller (``invoice_user_id``), ``product_id``, ``categ_id``, ``product_brand_id``,
    ``partner_id`` or ``analytic_account_id``."""
    report = sales_lines(tables, p).withColumn("month", month("invoice_date"))
    return pivot_groups(report, ["month", key], ["quantity", "price_subtotal"])


def purchase_pivot(tables: Tables, p: PeriodParams, key: str = "invoice_date") -> DataFrame:
    """Per invoice date, order (``purchase_id``) or ``invoice_id``, of invoices after the first day: untaxed and total.

    ``amount_total`` adds the header total of every line and so counts an invoice once per line;
    ``invoice_total`` counts each invoice once.
    """
    report = purchase_amounts(tables, p, key == "purchase_id").filter(after_until(F.col("invoice_date"), p.date_from, p.date_to))
    by_invoice = report.groupBy(*dict.fromkeys((key, "invoice_id"))).agg(
        F.sum("amount_untaxed").alias("amount_untaxed"),
        F.sum("amount_total").alias("amount_total"),
        F.max("amount_total").alias("invoice_total"),
    )
    return by_invoice.groupBy(key).agg(*_sums(["amount_untaxed", "amount_total", "invoice_total"]))


def journal_pivot_of_lines(tables: Tables, p: PeriodParams, key: str) -> DataFrame:
    """Per entry (``move_id``) or ``partner_id`` after the first day: number of entries, debit and credit."""
    moves = tables["account_move"].filter(after_until(F.col("date"), p.date_from, p.date_to))
    lines = in_months(tables["account_move_line"], p.date_from, p.date_to)
    lines = keep_ids(lines, "journal_id", p.journals).select("move_id", "partner_id", "debit", "credit")
    lines = lines.join(moves.select(F.col("id").alias("move_id")), "move_id", "left_semi")
    by_entry = lines.groupBy(*dict.fromkeys((key, "move_id"))).agg(*_sums(["debit", "credit"]))
    return by_entry.groupBy(key).agg(F.count("*").alias("entries"), *_sums(["debit", "credit"]))


def journal_pivot(tables: Tables, p: PeriodParams) -> DataFrame:
    """Number of entries with lines per date after the first day."""
    moves = tables["account_move"].filter(after_until(F.col("date"), p.date_from, p.date_to))
    lines = in_months(tables["account_move_line"], p.date_from, p.date_to)
    lines = keep_ids(lines, "journal_id", p.journals).select(
        F.col("move_id").alias("id")
    )
    return moves.select("id", "date").join(lines, "id", "left_semi").groupBy("date").agg(
        F.count("id").alias("entries")
    )


def journal_pivot_totals(tables: Tables, p: PeriodParams, key: str = "account_id") -> DataFrame:
    """Number of entries per date after the first day and ``key`` of their lines, with the totals of dates, keys and all.

    An entry counts once in a total, however many keys its lines have.
    """
    moves = tables["account_move"].filter(after_until(F.col("date"), p.date_from, p.date_to))
    lines = in_months(tables["account_move_line"], p.date_from, p.date_to)
    lines = keep_ids(lines, "journal_id", p.journals).select("move_id", key)
    dated = lines.join(moves.select(F.col("id").alias("move_id"), "date"), "move_id")
    return pivot_distinct(dated, ["date"], [key], "move_id", "entries")


def margin_pivot(tables: Tables, p: PeriodParams, key: str = "product_id") -> DataFrame:
    """Subtotal per product, or per ``product_brand_id``, with the grand total."""
    return pivot_groups(product_margin(tables, p), [key], ["price_subtotal"])


def stock_pivot(tables: Tables, p: StockParams, key: str = "location_id") -> DataFrame:
    """Stock per location, or per product, category or brand, with the grand total."""
    return pivot_groups(
        stock_availability(tables, p), [key], ["quantity", "reserved_quantity", "available_qty"]
    )


def report_footers(reports: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(report, measure, total) for several lists."""
    parts = []
    for name, (report, measures) in reports.items():
        footer = list_totals(report, measures)
        parts.append(
            footer.unpivot([], list(measures), "measure", "total").select(
                F.lit(name).alias("report"), "measure", F.col("total").cast("decimal(38,6)").alias("total")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

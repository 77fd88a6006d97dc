"""Journal audit and the printed journal book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_months, in_window, keep_ids
from ..functions.headers import AUDIT, with_headers
from ..functions.joins import lookup
from ..functions.labels import audit_state_label, entry_label, state_label
from ..functions.money import or_zero, two_decimals
from ..functions.sequences import with_previous_row
from ..params import JournalBookParams, PeriodParams
from ..sources.tables import Tables


def _entries_in(tables: Tables, p: PeriodParams) -> DataFrame:
    moves = tables["account_move"].filter(in_window(F.col("date"), p.date_from, p.date_to))
    return moves.select(
        F.col("id").alias("move_id"), "date", F.col("name").alias("move"), "state"
    )


def _audit(tables: Tables, p: PeriodParams) -> DataFrame:
    """Sums at the grain of the ids; the date is the entry's."""
    lines = keep_ids(in_months(tables["account_move_line"], p.date_from, p.date_to), "journal_id", p.journals)
    lines = lines.select(
        "move_id", "partner_id", "account_id", "journal_id", F.col("name").alias("name_aml"), "debit", "credit"
    )
    return (
        lines.join(_entries_in(tables, p), "move_id")
        .groupBy("move_id", "date", "move", "state", "partner_id", "account_id", "name_aml", "journal_id")
        .agg(or_zero(F.sum("debit")).alias("debit"), or_zero(F.sum("credit")).alias("credit"))
    )


def _partners(tables: Tables) -> DataFrame:
    return tables["res_partner"].select(
        F.col("id").alias("partner_id"), "vat", F.col("name").alias("partner")
    )


def journal_audit(tables: Tables, p: PeriodParams) -> DataFrame:
    """Debit and credit per date, entry, partner, account, label, journal and state, of every state.

    Ordered by entry, date and account.
    """
    rows = lookup(_audit(tables, p), _partners(tables), "partner_id", "move_id").select(
        "date", "move_id", F.col("vat").alias("partner_vat"), "partner_id", "account_id", "name_aml",
        "journal_id", "debit", "credit", "state",
    )
    ties = [F.asc_nulls_last(c) for c in ("partner_id", "name_aml", "journal_id")]
    return rows.orderBy("move_id", "date", "account_id", *ties)


def journal_audit_labelled(tables: Tables, p: PeriodParams) -> DataFrame:
    """As ``journal_audit`` keyed on names and codes: partners or entries of one name merge.

    The sums per id come first, so only those are regrouped by name.
    """
    accounts = tables["account_account"].select(F.col("id").alias("account_id"), F.col("code").alias("account"))
    rows = lookup(_audit(tables, p).join(accounts, "account_id", "left"), _partners(tables), "partner_id", "move_id")
    rows = (
        rows.groupBy("date", "move", "vat", "partner", "account", F.col("name_aml").alias("label"), "state")
        .agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
        .withColumn("state", audit_state_label(F.col("state")))
        .orderBy(
            F.asc_nulls_last("move"), "date", F.asc_nulls_last("account"),
            F.asc_nulls_last("partner"), F.asc_nulls_last("vat"), F.asc_nulls_last("label"),
        )
    )
    return with_headers(rows, AUDIT)


def _book(tables: Tables, p: JournalBookParams) -> DataFrame:
    """Lines in the window whose entry is in a chosen journal and state, with ``journal_id`` of the entry."""
    states = ["posted"] if p.target_move == "posted" else ["draft", "posted", "cancel"]
    moves = keep_ids(tables["account_move"].filter(F.col("state").isin(*states)), "journal_id", p.journals)
    moves = moves.select(
        F.col("id").alias("move_id"), F.col("name").alias("move"), F.col("state").alias("move_state"), "journal_id"
    )
    lines = in_months(tables["account_move_line"], p.date_from, p.date_to).filter(in_window(F.col("date"), p.date_from, p.date_to))
    return lines.drop("journal_id").withColumnRenamed("name", "label").join(moves, "move_id")


def _named_lines(tables: Tables, p: JournalBookParams) -> DataFrame:
    accounts = tables["account_account"].select(
        F.col("id").alias("account_id"), F.col("code").alias("account_code"), F.col("name").alias("account_name")
    )
    rows = lookup(_book(tables, p).join(accounts, "account_id", "left"), _partners(tables), "partner_id", "id")
    return rows.select(
        F.col("id").alias("line_id"), "journal_id", "date", "move_id", "move", "partner",
        "account_code", "account_name", "label", "debit", "credit", "move_state",
    )


def _leading(p: JournalBookParams) -> str:
    return "date" if p.sort_by == "date" else "move"


def journal_book_lines(tables: Tables, p: JournalBookParams) -> DataFrame:
    """Lines by journal, then date or entry name, entry and account code."""
    return _sorted_book(_named_lines(tables, p), p).drop("line_id")


def _sorted_book(rows: DataFrame, p: JournalBookParams) -> DataFrame:
    return rows.orderBy("journal_id", _leading(p), "move_id", "account_code", "label", "debit", "credit", "line_id")


def journal_book_totals(tables: Tables, p: JournalBookParams) -> DataFrame:
    """Total debit and credit per journal, each line counted once."""
    return (
        _book(tables, p)
        .groupBy("journal_id")
        .agg(or_zero(F.sum("debit")).alias("debit"), or_zero(F.sum("credit")).alias("credit"))
    )


def journal_book_totals_text(tables: Tables, p: JournalBookParams) -> DataFrame:
    """The totals as the book prints them, with two decimals."""
    return journal_book_totals(tables, p).select(
        "journal_id", two_decimals(F.col("debit")).alias("debit"), two_decimals(F.col("credit")).alias("credit")
    )


def journal_book_taxes(tables: Tables, p: JournalBookParams) -> DataFrame:
    """Per journal and tax: base of the lines bearing the tax, amount of the lines generated by it.

    The lines bearing a tax decide which taxes are listed. Sales journals turn both signs. A line is read
    once and taken as a base, matched to the taxes it bears by its id, and as a tax amount where it is one;
    the latter carries a key below zero, which no id has.
    """
    bearing = tables["account_move_line_account_tax_rel"].select(
        F.col("account_move_line_id").alias("key"), F.col("account_tax_id").alias("borne_tax_id")
    )
    as_base = "named_struct('key', id, 'tax_id', NULL, 'base', balance, 'amount', NULL)"
    as_tax = "named_struct('key', -1 - id, 'tax_id', tax_line_id, 'base', NULL, 'amount', debit - credit)"
    parts = _book(tables, p).selectExpr(
        "journal_id", f"inline(IF(tax_line_id IS NULL, array({as_base}), array({as_base}, {as_tax})))"
    )
    taxes = (
        parts.join(bearing, "key", "left")
        .withColumn("tax_id", F.coalesce("borne_tax_id", "tax_id"))
        .filter("tax_id IS NOT NULL")
        .groupBy("journal_id", "tax_id")
        .agg(
            F.sum("base").alias("base_amount"),
            F.sum("amount").alias("tax_amount"),
            F.count("borne_tax_id").alias("bearing_lines"),
        )
        .filter("bearing_lines > 0")
    )
    journals = tables["account_journal"].select(F.col("id").alias("journal_id"), "type")
    sign = F.when(F.col("type") == "sale", -1).otherwise(1)
    return (
        taxes.join(journals, "journal_id")
        .select(
            "journal_id", "tax_id", (F.col("base_amount") * sign).alias("base_amount"),
            (or_zero(F.col("tax_amount")) * sign).alias("tax_amount"),
        )
    )





def journal_book_print_rows(tables: Tables, p: JournalBookParams) -> DataFrame:
    """Printed rows: entry, date and partner are left blank where they repeat the row above.

    A new entry shows all three again, and general journals always show the partner. Entries without a
    number print as ``*<id>``. Zero amounts are blank.
    """
    journals = tables["account_journal"].select(F.col("id").alias("journal_id"), "type")
    rows = _named_lines(tables, p).withColumns(
        {
            "entry": entry_label(F.col("move"), F.col("move_id")),
            "partner": F.coalesce("partner", F.lit("")),
        }
    )
    order = [F.col(c) for c in ("move_id", "account_code", "label", "debit", "credit", "line_id")]
    rows = with_previous_row(
        rows, ["entry", "date", "partner"], [F.col("journal_id"), F.col(_leading(p))], order
    ).join(journals, "journal_id", "left")

    new_entry = F.col("previous").isNull() | (F.col("previous.entry") != F.col("entry"))
    new_date = new_entry if p.sort_by == "date" else new_entry | (F.col("previous.date") != F.col("date"))
    shows_partner = (
        new_entry | (F.col("previous.partner") != F.col("partner")) | (F.col("type") == "general")
    )
    return _sorted_book(rows, p).select(
        "journal_id",
        "move_id",
        F.when(new_entry, F.col("entry")).alias("entry"),
        F.when(new_date, F.col("date")).alias("date"),
        F.when(shows_partner, F.nullif("partner", F.lit(""))).alias("partner"),
        F.concat_ws(" ", "account_code", "account_name").alias("account"),
        "label",
        F.when(F.col("debit") != 0, F.col("debit")).alias("debit"),
        F.when(F.col("credit") != 0, F.col("credit")).alias("credit"),
        state_label(F.col("move_state"), None).alias("state"),
    )

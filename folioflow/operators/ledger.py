"""Auxiliary ledger: detail lines and subtotals with opening and closing balances.

The subtotals read the lines up to ``date_to`` once: opening, movement and closing are conditional sums
of one partial + final aggregation, and names are joined to the small result. Ledger subtotals list the
keys that have a line inside the window (a key with an opening only does not appear). Where balances of
closed months are kept (``sources.balances``), they stand for the lines before the window's first month.

Foreign keys of the lines are taken as valid, so entries are only joined where a report shows them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import day, in_months, in_window, keep_ids
from ..functions.headers import LEDGER, with_headers
from ..functions.hierarchy import group_members, rolled_up
from ..functions.joins import lookup
from ..functions.labels import NO_PARTNER, TOTAL, partner_label, state_label
from ..functions.money import european_number, no_amount, or_zero
from ..functions.sequences import with_running_sum
from ..params import LedgerParams
from ..sources.balances import lines_until
from ..sources.scratch import written
from ..sources.tables import Tables


def _chosen_lines(lines: DataFrame, p: LedgerParams) -> DataFrame:
    """Line filter of the ledger without its dates. Lines with no ``ifrs_type`` are in neither book."""
    lines = lines.filter(F.col("company_id").isin(*p.companies))
    if p.posted_only:
        lines = lines.filter(F.col("parent_state") == "posted")
    lines = lines.filter(F.col("ifrs_type") != p.other_book)
    lines = keep_ids(lines, "account_id", p.accounts)
    lines = keep_ids(lines, "partner_id", p.partners)
    lines = keep_ids(lines, "analytic_account_id", p.analytics)
    if p.omit_zero:
        lines = lines.filter(or_zero(F.col(p.debit)) - or_zero(F.col(p.credit)) != 0)
    return lines


def _balances(lines: DataFrame, keys: Sequence[str], p: LedgerParams, opening: Column, inside: Column) -> DataFrame:
    """Per key: initial, debit, credit, final and the number of lines in the window.

    Opening and closing sum ``debit - credit`` (a line with one side NULL does not count), the movement
    takes each side by itself.
    """
    debit, credit = F.col(p.debit), F.col(p.credit)
    return lines.groupBy(*keys).agg(
        or_zero(F.sum(F.when(opening, debit - credit))).alias("initial"),
        or_zero(F.sum(F.when(inside, debit))).alias("debit"),
        or_zero(F.sum(F.when(inside, credit))).alias("credit"),
        or_zero(F.sum(debit - credit)).alias("final"),
        F.count_if(inside).alias("n_in_window"),
    )


def _window_balances(tables: Tables, p: LedgerParams, keys: Sequence[str]) -> DataFrame:
    date = F.col("date")
    lines = _chosen_lines(lines_until(tables, p.date_from, p.date_to), p).filter(date <= day(p.date_to))
    return (
        _balances(lines, keys, p, date < day(p.date_from), date >= day(p.date_from))
        .filter("n_in_window > 0")
        .drop("n_in_window")
    )


def _with_account(rows: DataFrame, tables: Tables) -> DataFrame:
    accounts = tables["account_account"].select(
        F.col("id").alias("account_id"), "code", F.col("name").alias("account_name")
    )
    return rows.join(accounts, "account_id")


def _with_partner(rows: DataFrame, tables: Tables, line_id: str | None = None) -> DataFrame:
    """``line_id`` is given where the rows are lines and many may lack a partner."""
    partners = tables["res_partner"].select(
        F.col("id").alias("partner_id"), "vat", F.col("name").alias("partner_name")
    )
    named = lookup(rows, partners, "partner_id", line_id) if line_id else rows.join(partners, "partner_id", "left")
    return named.withColumn("partner", partner_label(F.col("partner_name")))


def _columns(p: LedgerParams) -> list[str]:
    """Report columns in order; they depend on nothing but the parameters."""
    return [
        *("bold", "group", "account_id", "code", "name", "vat", "partner", "date", "journal"),
        *(["analytic"] if p.with_analytic else []),
        *("move", "line"),
        *(["currency", "amount"] if p.with_currency else []),
        *("initial", "debit", "credit", "final", "state"),
    ]


def _empty(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _subtotal_rows(rows: DataFrame, p: LedgerParams, date: Column | None = None, **cells: Column) -> DataFrame:
    """Lay subtotals out in the report columns; cells a subtotal does not have are NULL."""
    given = {
        "bold": F.lit(True),
        "group": F.lit(False),
        "date": _empty("date") if date is None else date,
        "account_id": _empty("bigint"),
        "amount": _empty("decimal(18,2)"),
        **{c: F.col(c) for c in ("initial", "debit", "credit", "final")},
        **cells,
    }
    return rows.select(*[given.get(c, _empty()).alias(c) for c in _columns(p)])


def _detail(tables: Tables, p: LedgerParams) -> DataFrame:
    """Report columns, ``line_id`` for the order, and ``net``, debit - credit."""
    lines = _chosen_lines(in_months(tables["account_move_line"], p.date_from, p.date_to), p).filter(
        in_window(F.col("date"), p.date_from, p.date_to)
    )
    moves = tables["account_move"].select(
        F.col("id").alias("move_id"), F.col("name").alias("move"), F.col("state").alias("move_state")
    )
    journals = tables["account_journal"].select(
        F.col("id").alias("journal_id"), F.col("name").alias("journal")
    )
    rows = _with_account(lines.withColumnRenamed("name", "line").join(moves, "move_id"), tables)
    rows = _with_partner(rows.join(journals, "journal_id"), tables, "id")
    if p.with_analytic:
        analytics = tables["account_analytic_account"].select(
            F.col("id").alias("analytic_account_id"), F.col("name").alias("analytic")
        )
        rows = lookup(rows, analytics, "analytic_account_id", "id")
    if p.with_currency:
        currencies = tables["res_currency"].select(
            F.col("id").alias("currency_id"), F.col("name").alias("currency")
        )
        rows = lookup(rows, currencies, "currency_id", "id")
    cells = {
        "bold": F.lit(False),
        "group": F.lit(False),
        "name": F.col("account_name"),
        "amount": F.col("amount_currency"),
        "initial": no_amount(),
        "debit": or_zero(F.col(p.debit)),
        "credit": or_zero(F.col(p.credit)),
        "final": no_amount(),
        "state": state_label(F.col("move_state")),
    }
    net = (F.col(p.debit) - F.col(p.credit)).alias("net")
    return rows.select(*[cells.get(c, F.col(c)).alias(c) for c in _columns(p)], F.col("id").alias("line_id"), net)


def ledger_detail(tables: Tables, p: LedgerParams) -> DataFrame:
    """Lines in the window with account, entry, journal and partner; opening and closing stay empty.

    Ordered by date, entry and partner name, lines without a partner last.
    """
    order = ["date", "move", F.col("partner") == NO_PARTNER, "partner", "line_id"]
    return with_headers(_detail(tables, p).orderBy(*order).drop("line_id", "net"), LEDGER)


def ledger_by_account(tables: Tables, p: LedgerParams) -> DataFrame:
    """Per account, by its code: opening, movement, closing. Here opening + debit - credit = closing."""
    return _by_account(tables, p).orderBy("code", "account_id")


def _entry_sums(tables: Tables, p: LedgerParams) -> DataFrame:
    """Per (account, partner, entry): what came before the window, and in it net, debit, credit and lines.

    Subtotals of several levels are built from these sums, so together they read the lines once.
    """
    date, debit, credit = F.col("date"), F.col(p.debit), F.col(p.credit)
    lines = _chosen_lines(lines_until(tables, p.date_from, p.date_to), p).filter(date <= day(p.date_to))
    before, inside = date < day(p.date_from), date >= day(p.date_from)
    return lines.groupBy("account_id", "partner_id", "move_id").agg(
        or_zero(F.sum(F.when(before, debit - credit))).alias("before"),
        or_zero(F.sum(F.when(inside, debit - credit))).alias("net"),
        or_zero(F.sum(F.when(inside, debit))).alias("debit"),
        or_zero(F.sum(F.when(inside, credit))).alias("credit"),
        F.count_if(inside).alias("n"),
    )


def _whole(sums: DataFrame) -> DataFrame:
    """The sums with every column in use. Spark prunes columns for each use apart, and only uses of the same columns share
    their exchange; no sum reaches the bound."""
    bound = F.lit("1" + 25 * "0").cast("decimal(28,2)")
    return sums.filter((F.greatest("before", "net", "debit", "credit") < bound) & (F.col("n") >= 0))


def _balances_of(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Balances of the keys that have a line in the window, from entry sums."""
    return (
        _whole(sums)
        .groupBy(*keys)
        .agg(
            F.sum("before").alias("initial"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"),
            (F.sum("before") + F.sum("net")).alias("final"), F.sum("n").alias("n"),
        )
        .filter("n > 0")
        .drop("n")
    )


def _by_account(
    tables: Tables, p: LedgerParams, date: Column | None = None, sums: DataFrame | None = None
) -> DataFrame:
    keys = ["account_id"]
    balances = _window_balances(tables, p, keys) if sums is None else _balances_of(sums, keys)
    rows = _with_account(balances, tables)
    return _subtotal_rows(
        rows, p, date, account_id=F.col("account_id"), code=F.col("code"), name=F.col("account_name")
    )


def ledger_by_account_partner(tables: Tables, p: LedgerParams) -> DataFrame:
    """One row per (account, partner, entry) in the window.

    Debit and credit belong to the entry; opening and closing belong to (account, partner) and repeat on
    each of its entries, so opening + debit - credit is not the closing here. Ordered by account code and partner.
    """
    return _by_account_partner(tables, p, _entry_sums(tables, p), ordered=True)


def _by_account_partner(
    tables: Tables, p: LedgerParams, sums: DataFrame, date: Column | None = None, ordered: bool = False
) -> DataFrame:
    keys = ["account_id", "partner_id"]
    balances = _balances_of(sums, keys).select(*keys, "initial", "final")
    entries = _whole(sums).filter("n > 0")
    e, b = entries.alias("e"), balances.alias("b")
    rows = e.join(
        b,
        (F.col("e.account_id") == F.col("b.account_id"))
        & F.col("e.partner_id").eqNullSafe(F.col("b.partner_id")),
    ).select("e.account_id", "e.partner_id", "e.move_id", "e.debit", "e.credit", "b.initial", "b.final")
    rows = _with_partner(_with_account(rows, tables), tables)
    if ordered:
        rows = rows.orderBy("code", F.asc_nulls_last("partner_id"), "account_id", "move_id")
    return _subtotal_rows(
        rows,
        p,
        date,
        account_id=F.col("account_id"),
        code=F.col("code"),
        name=F.col("account_name"),
        vat=F.col("vat"),
        partner=F.col("partner"),
    )


def ledger_by_partner(tables: Tables, p: LedgerParams) -> DataFrame:
    """Per partner over all accounts: opening, movement, closing.

    Grouped by the partner itself, which is what the report means to show. Ordered by tax number.
    """
    return _by_partner(tables, p).orderBy(F.asc_nulls_last("vat"), "partner")


def _by_partner(
    tables: Tables, p: LedgerParams, date: Column | None = None, sums: DataFrame | None = None
) -> DataFrame:
    keys = ["partner_id"]
    balances = _window_balances(tables, p, keys) if sums is None else _balances_of(sums, keys)
    rows = _with_partner(balances, tables)
    return _subtotal_rows(rows, p, date, vat=F.col("vat"), partner=F.col("partner"))


def ledger_by_account_text(tables: Tables, p: LedgerParams) -> DataFrame:
    """Account subtotals with their amounts as preview texts (1.234,50)."""
    amounts = ("initial", "debit", "credit", "final")
    return ledger_by_account(tables, p).select(
        "code", "name", *[european_number(F.col(c)).alias(c) for c in amounts]
    )


def _text_key(column: str) -> Column:
    """Sort key of a text cell: an empty cell sorts first."""
    return F.coalesce(F.col(column), F.lit("")).asc()


def _combine(tables: Tables, p: LedgerParams, parts: list[DataFrame]) -> DataFrame:
    """Detail, then subtotal parts; ``_part`` and ``line_id`` make the order total."""
    rows = _detail(tables, p).drop("net").withColumn("_part", F.lit(len(parts)))
    for number, part in enumerate(parts):
        rows = rows.unionByName(part.withColumn("_part", F.lit(number)), allowMissingColumns=True)
    return rows


def _ordered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    ties = [
        F.desc("bold"),
        F.asc("_part"),
        _text_key("code"),
        _text_key("partner"),
        F.asc_nulls_first("date"),
        _text_key("move"),
        F.asc_nulls_first("line_id"),
        F.asc("debit"),
        F.asc("credit"),
    ]
    return with_headers(rows.orderBy(*keys, *ties).drop("_part", "line_id"), LEDGER)


def ledger_combined(tables: Tables, p: LedgerParams) -> DataFrame:
    """Detail with the chosen subtotals, each subtotal row (``bold``) leading its block.

    Order: by partner level (code, entry, partner), account level (code), account and partner level
    (partner, code), else (date, entry, partner). The first chosen of these decides.
    """
    parts = []
    sums = _entry_sums(tables, p) if "account_partner" in p.levels else None
    if sums is not None:
        parts.append(_by_account_partner(tables, p, sums))
    if "account" in p.levels:
        parts.append(_by_account(tables, p, sums=sums))
    if "partner" in p.levels:
        parts.append(_by_partner(tables, p, sums=sums))
    if "partner" in p.levels:
        keys = [_text_key("code"), _text_key("move"), _text_key("partner")]
    elif "account" in p.levels:
        keys = [_text_key("code")]
    elif "account_partner" in p.levels:
        keys = [_text_key("partner"), _text_key("code")]
    else:
        keys = [F.coalesce("date", F.current_date()).asc(), _text_key("move"), _text_key("partner")]
    return _ordered(_combine(tables, p, parts), keys)


def ledger_combined_v2(tables: Tables, p: LedgerParams) -> DataFrame:
    """Variant with one level at a time, where ``account_partner`` brings the account subtotals too.

    Subtotals are dated on the first day of the window and sort by date and entry within their block.
    """
    if len(p.levels) > 1:
        raise ValueError("this variant takes one level at a time")
    level = p.levels[0] if p.levels else None
    start = day(p.date_from)
    parts = []
    sums = _entry_sums(tables, p) if level == "account_partner" else None
    if sums is not None:
        parts.append(_by_account_partner(tables, p, sums, start))
    if level in ("account", "account_partner"):
        parts.append(_by_account(tables, p, start, sums))
    if level == "partner":
        parts.append(_by_partner(tables, p, start))
    by_entry = [F.asc("date"), _text_key("move")]
    keys = {
        "account_partner": [_text_key("code"), _text_key("partner"), *by_entry],
        "account": [_text_key("code"), *by_entry],
        "partner": [_text_key("partner"), _text_key("code"), *by_entry],
        None: [*by_entry, _text_key("partner")],
    }[level]
    return _ordered(_combine(tables, p, parts), keys)


def tax_ledger_order(tables: Tables, p: LedgerParams) -> DataFrame:
    """Ledger lines in the order of the tax ledger: code, partner, date, entry."""
    rows = _detail(tables, p)
    return rows.orderBy(
        _text_key("code"), _text_key("partner"), F.asc("date"), _text_key("move"), F.asc("line_id")
    ).drop("line_id", "net")


def ledger_detail_with_balances(tables: Tables, p: LedgerParams) -> DataFrame:
    """Lines in the window, each with the opening and closing of its (account, partner).

    The balances are those of the local book over all companies, states and books.
    """
    keys = ["account_id", "partner_id"]
    date, lines = F.col("date"), tables["account_move_line"]
    balances = (
        lines_until(tables, p.date_from, p.date_to).filter(date <= day(p.date_to))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(date < day(p.date_from), F.col("debit") - F.col("credit"))).alias("initial"),
            F.sum(F.col("debit") - F.col("credit")).alias("final"),
        )
    )
    chosen = in_months(lines, p.date_from, p.date_to).filter(in_window(date, p.date_from, p.date_to)).filter(F.col("ifrs_type") != p.other_book)
    if p.posted_only:
        chosen = chosen.filter(F.col("parent_state") == "posted")
    chosen = keep_ids(keep_ids(chosen, "account_id", p.accounts), "partner_id", p.partners)
    chosen = chosen.select(
        "id", *keys, "move_id", "journal_id", "date", F.col("name").alias("line"),
        or_zero(F.col(p.debit)).alias("debit"), or_zero(F.col(p.credit)).alias("credit"),
    )
    moves = tables["account_move"].select(F.col("id").alias("move_id"), F.col("name").alias("move"))
    journals = tables["account_journal"].select(
        F.col("id").alias("journal_id"), F.col("name").alias("journal")
    )
    chosen = chosen.join(moves, "move_id").join(journals, "journal_id")
    c, b = chosen.alias("c"), balances.alias("b")
    rows = c.join(
        b,
        (F.col("c.account_id") == F.col("b.account_id"))
        & F.col("c.partner_id").eqNullSafe(F.col("b.partner_id")),
        "left",
    ).select("c.*", "b.initial", "b.final")
    rows = _with_account(rows, tables)
    return _with_partner(rows, tables, "id").select(
        F.lit(False).alias("bold"),
        F.lit(False).alias("group"),
        "account_id",
        "code",
        F.col("account_name").alias("name"),
        "partner_id",
        "vat",
        "partner",
        "date",
        "journal",
        "move",
        "line",
        or_zero(F.col("initial")).alias("initial"),
        "debit",
        "credit",
        or_zero(F.col("final")).alias("final"),
    )


def partner_subtotals(tables: Tables, p: LedgerParams) -> DataFrame:
    """Per account and partner of the ledger lines: opening from the whole ledger, closing from it.

    The opening obeys the state filter only; in the IFRS book it follows the mapped account
    (``ifrs_account_id``). closing = opening + debit - credit.
    """
    lines, date = tables["account_move_line"], F.col("date")
    keys = ["account_id", "partner_id"]
    movement = (
        _chosen_lines(in_months(lines, p.date_from, p.date_to), p)
        .filter(in_window(date, p.date_from, p.date_to))
        .groupBy(*keys)
        .agg(
            F.sum(or_zero(F.col(p.debit))).alias("debit"), F.sum(or_zero(F.col(p.credit))).alias("credit")
        )
    )
    before = lines_until(tables, p.date_from, p.date_from, net=False).filter(date < day(p.date_from))
    if p.posted_only:
        before = before.filter(F.col("parent_state") == "posted")
    opening = before.groupBy(*keys).agg(
        or_zero(F.sum(p.debit)).alias("_debit"), or_zero(F.sum(p.credit)).alias("_credit")
    )
    if p.book == "ifrs":
        mapped = tables["account_account"].select(F.col("id").alias("account_id"), "ifrs_account_id")
        opening = opening.join(mapped, "account_id").withColumn("account_id", F.col("ifrs_account_id"))

    def by_partner_name(rows: DataFrame, first: str, second: str) -> DataFrame:
        return (
            _with_partner(rows, tables)
            .groupBy("account_id", "vat", "partner")
            .agg(F.sum(first).alias(first), F.sum(second).alias(second))
        )

    m = by_partner_name(movement, "debit", "credit").alias("m")
    o = by_partner_name(opening, "_debit", "_credit").alias("o")
    rows = m.join(
        o,
        (F.col("m.account_id") == F.col("o.account_id"))
        & F.col("m.vat").eqNullSafe(F.col("o.vat"))
        & (F.col("m.partner") == F.col("o.partner")),
        "left",
    ).select(
        "m.account_id", "m.vat", "m.partner", "m.debit", "m.credit",
        (or_zero(F.col("_debit")) - or_zero(F.col("_credit"))).alias("initial"),
    )
    return _with_account(rows, tables).select(
        F.lit(True).alias("bold"),
        F.lit(False).alias("group"),
        "account_id",
        "code",
        "vat",
        "partner",
        F.concat(F.lit(f"{TOTAL}: "), "partner").alias("line"),
        "initial",
        "debit",
        "credit",
        (F.col("initial") + F.col("debit") - F.col("credit")).alias("final"),
    )


def ledger_running_balance(tables: Tables, p: LedgerParams) -> DataFrame:
    """Lines in the window, each with the balance of its account after it.

    The balance starts at the account's opening and adds debit - credit in the order of date, entry and label, so that of
    an account's last line is its closing; a line with one side NULL adds nothing, as in the subtotals. Ordered by
    account code.
    """
    order = [F.col(c) for c in ("date", "move", "line", "debit", "credit", "line_id")]
    rows = with_running_sum(_detail(tables, p), "net", "running", ["account_id"], order)
    openings = _window_balances(tables, p, ["account_id"]).select(F.col("account_id").alias("_account"), F.col("initial").alias("_opening"))
    rows = rows.join(openings, rows["account_id"] == openings["_account"]).withColumn("balance", F.col("_opening") + F.col("running"))
    rows = rows.orderBy("code", "account_id", *order).select(*[c for c in _columns(p) if c not in ("initial", "final")], "balance")
    return with_headers(rows, LEDGER)


def ledger_group_rollup(tables: Tables, p: LedgerParams) -> DataFrame:
    """Account subtotals rolled up to their account group and on to each parent group.

    An account belongs to the group with the longest code its own code starts with.
    """
    groups, amounts = tables["account_group"], ("initial", "debit", "credit", "final")
    accounts = _by_account(tables, p).select("bold", "group", "account_id", "code", "name", *amounts)
    # Written, as the rounds of the roll-up and the listing both start from them: the lines are read once.
    accounts = written(accounts, "subtotals")
    direct = (
        group_members(tables["account_account"], groups)
        .groupBy("account_id")
        .agg(F.max_by("group_id", "prefix_length").alias("id"))
    )
    sums = rolled_up(groups, accounts.select("account_id", *amounts).join(direct, "account_id"), amounts)
    rolled = sums.join(groups.select("id", "code", "name"), "id").select(
        F.lit(True).alias("bold"), F.lit(True).alias("group"), F.col("id").alias("account_id"), "code", "name", *amounts
    )
    return accounts.unionByName(rolled).orderBy("code", F.desc("group"))

"""Trial balance: opening residual, movement and balance per account, analytic account and partner.

One scan of the lines up to ``date_to`` gives the key set, the residual and the movement together. All
those lines make keys, whatever their book; only the lines of the book add amounts. Balances of closed
months, where they are kept, stand for the lines before the window's first month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import day, keep_ids
from ..functions.headers import BALANCE, with_headers
from ..functions.hierarchy import group_members
from ..functions.labels import TOTAL
from ..functions.money import or_zero
from ..params import BalanceParams
from ..sources.balances import lines_until
from ..sources.tables import Tables

AMOUNTS = ("residual", "debit", "credit", "balance")
NO_ANALYTIC = "/"


def _not_zero() -> Column:
    return (F.col("residual") != 0) | (F.col("balance") != 0)


def _rows(tables: Tables, p: BalanceParams) -> DataFrame:
    """Keys with their amounts and account names, before the other names are joined."""
    lines = lines_until(tables, p.date_from, p.date_to, net=False).filter(
        (F.col("date") <= day(p.date_to)) & F.col("company_id").isin(*p.companies)
    )
    if p.posted_only:
        lines = lines.filter(F.col("parent_state") == "posted")
    lines = keep_ids(lines, "account_id", p.accounts)
    lines = keep_ids(lines, "analytic_account_id", p.analytics)
    if p.by_partner:
        lines = keep_ids(lines, "partner_id", p.partners)
    keys = [
        "account_id",
        *(["analytic_account_id"] if p.by_analytic else []),
        *(["partner_id"] if p.by_partner else []),
    ]
    in_book = F.col("ifrs_type") != p.other_book
    before, inside = F.col("date") < day(p.date_from), F.col("date") >= day(p.date_from)

    def total(side: str, when: Column) -> Column:
        return or_zero(F.sum(F.when(in_book & when, F.col(side))))

    rows = lines.groupBy(*keys).agg(
        (total(p.debit, before) - total(p.credit, before)).alias("residual"),
        total(p.debit, inside).alias("debit"),
        total(p.credit, inside).alias("credit"),
    )
    rows = rows.withColumn("balance", F.col("residual") + F.col("debit") - F.col("credit"))
    if p.omit_zero:
        rows = rows.filter(_not_zero())
    accounts = tables["account_account"].select(F.col("id").alias("account_id"), "code", "name")
    return rows.join(accounts, "account_id")


def _columns(p: BalanceParams) -> list[str]:
    return [
        *("bold", "group", "account_id", "parent_id", "group_id", "code", "name"),
        *(["analytic_name"] if p.by_analytic else []),
        *(["vat", "partner"] if p.by_partner else []),
        *AMOUNTS,
    ]


def _lay_out(rows: DataFrame, p: BalanceParams, **cells: Column) -> DataFrame:
    given = {
        **{c: F.lit(None).cast("bigint") for c in ("account_id", "parent_id", "group_id")},
        **{c: F.lit(None).cast("string") for c in ("code", "name", "analytic_name", "vat", "partner")},
        **{a: F.col(a) for a in AMOUNTS},
        **cells,
    }
    return rows.select(*[given[c].alias(c) for c in _columns(p)])


def _detail(rows: DataFrame, tables: Tables, p: BalanceParams) -> DataFrame:
    if p.by_analytic:
        analytics = tables["account_analytic_account"].select(
            F.col("id").alias("analytic_account_id"), F.col("name").alias("analytic_name")
        )
        rows = rows.join(analytics, "analytic_account_id", "left")
    if p.by_partner:
        partners = tables["res_partner"].select(
            F.col("id").alias("partner_id"), "vat", F.col("name").alias("partner")
        )
        rows = rows.join(partners, "partner_id", "left")
    cells = ["account_id", "code", "name"]
    cells += ["analytic_name"] if p.by_analytic else []
    cells += ["vat", "partner"] if p.by_partner else []
    return _lay_out(
        rows, p, bold=F.lit(False), group=F.lit(False), **{c: F.col(c) for c in cells}
    )


def _total(rows: DataFrame, p: BalanceParams) -> DataFrame:
    totals = rows.agg(*[or_zero(F.sum(a)).alias(a) for a in AMOUNTS])
    return _lay_out(totals, p, bold=F.lit(True), group=F.lit(False), name=F.lit(TOTAL))


def trial_balance(tables: Tables, p: BalanceParams) -> DataFrame:
    """Rows per account and analytic account, and per partner where ``by_partner`` is set.

    residual = before the window, balance = residual + movement. With ``omit_zero`` a row needs a
    residual or a balance. Ordered by account code.
    """
    return with_headers(_detail(_rows(tables, p), tables, p).orderBy(*_row_order(p)), BALANCE)


def trial_balance_total(tables: Tables, p: BalanceParams) -> DataFrame:
    """The rows and, last, their total."""
    rows = _rows(tables, p)
    listed = _detail(rows, tables, p).withColumn("_last", F.lit(False))
    total = _total(rows, p).withColumn("_last", F.lit(True))
    return listed.unionByName(total).orderBy("_last", *_row_order(p)).drop("_last")


def _row_order(p: BalanceParams) -> list[Column]:
    """Code, then subtotal rows ahead of the detail, then names to make the order complete."""
    return [
        F.asc_nulls_last("code"),
        F.desc("bold"),
        F.desc("group"),
        *([F.asc_nulls_last("analytic_name")] if p.by_analytic else []),
        *([F.asc_nulls_last("partner"), F.asc_nulls_last("vat")] if p.by_partner else []),
    ]


def trial_balance_levels(tables: Tables, p: BalanceParams) -> DataFrame:
    """Rows, account subtotals, subtotals of every account group, and the total last.

    Groups add up the subtotals of the accounts whose code starts with theirs, and ``omit_zero`` applies
    to groups as well. The total adds up the plain rows only.
    """
    rows = _rows(tables, p)
    subtotals = rows.groupBy("account_id", "code", "name").agg(*[F.sum(a).alias(a) for a in AMOUNTS])
    groups = tables["account_group"]
    members = group_members(tables["account_account"], groups).select("account_id", "group_id")
    by_group = (
        subtotals.join(members, "account_id")
        .groupBy("group_id")
        .agg(*[F.sum(a).alias(a) for a in AMOUNTS])
    )
    named = groups.select(F.col("id").alias("group_id"), "parent_id", "code", "name")
    if p.omit_zero:
        by_group = by_group.filter(_not_zero()).join(named, "group_id")
    else:
        by_group = named.join(by_group, "group_id", "left").withColumns({a: or_zero(F.col(a)) for a in AMOUNTS})
    marked = {"analytic_name": F.lit(NO_ANALYTIC)} if p.by_analytic else {}
    listed = (
        _detail(rows, tables, p)
        .unionByName(
            _lay_out(
                subtotals, p, bold=F.lit(True), group=F.lit(False),
                **{c: F.col(c) for c in ("account_id", "code", "name")}, **marked,
            )
        )
        .unionByName(
            _lay_out(
                by_group, p, bold=F.lit(True), group=F.lit(True),
                parent_id=F.nullif(F.col("parent_id"), F.lit(0).cast("bigint")),
                **{c: F.col(c) for c in ("group_id", "code", "name")}, **marked,
            )
        )
        .withColumn("_last", F.lit(False))
    )
    total = _total(rows, p).withColumn("_last", F.lit(True))
    return listed.unionByName(total).orderBy("_last", *_row_order(p)).drop("_last")


def trial_balance_no_analytic(tables: Tables, p: BalanceParams) -> DataFrame:
    """Trial balance whose analytic dimension is left out."""
    if p.by_analytic:
        raise ValueError("use by_analytic=False")
    return trial_balance(tables, p)

"""Balances of closed months, kept beside the ledger so that a report needn't read its whole history.

A row holds the sums of a month for one account, partner, analytic account, company, state and book. Sums add up, so the
rows stand for the lines of their month wherever a report sums what came before its window: it reads the rows of closed
months, and the lines of the month in which its window begins and of later ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import day, in_months
from .sinks import replace_partitions
from .tables import Tables

KEYS = ("account_id", "partner_id", "analytic_account_id", "company_id", "parent_state", "ifrs_type")
SIDES = ("debit", "credit", "ifrs_debit", "ifrs_credit")
MONTH = "balance_month"
#: Table property that names the first day of the first month that isn't closed.
CLOSED = "balances.closed"


def _month(value: date) -> str:
    return value.strftime("%Y-%m")


def month_balances(lines: DataFrame) -> DataFrame:
    """Sums of every key and month: each side of both books, and ``net``, the sum of debit - credit.

    The nets are kept apart from the sides, as a line with one side NULL counts in its side and not in the net. Lines
    without a date are in no report and have no month.
    """
    dated = lines.filter(F.col("date").isNotNull())
    return dated.groupBy(*KEYS, F.date_format("date", "yyyy-MM").alias(MONTH)).agg(
        *[F.sum(s).alias(s) for s in SIDES],
        F.sum(F.col("debit") - F.col("credit")).alias("net"),
        F.sum(F.col("ifrs_debit") - F.col("ifrs_credit")).alias("ifrs_net"),
    )


@dataclass(frozen=True)
class BalanceCube:
    """Month balances, complete for all months before ``closed``, the first day of a month. Later months aren't used."""

    rows: DataFrame
    closed: date

    def __post_init__(self) -> None:
        if self.closed.day != 1:
            raise ValueError(f"closed must be the first day of a month, got {self.closed}")

    def before(self, first_open: date, net: bool) -> DataFrame:
        """The closed months before a day as lines: one for each key and month, dated on its first day.

        With ``net`` a line's debit is the net of its month and its credit zero; else the sides are the months' sums.
        """
        rows = self.rows.filter(F.col(MONTH) < _month(first_open))
        zero = F.lit(0).cast("decimal(18,2)")
        sides = {s: F.col(s) for s in SIDES}
        if net:
            sides = {"debit": F.col("net"), "credit": zero, "ifrs_debit": F.col("ifrs_net"), "ifrs_credit": zero}
        dated = F.to_date(F.concat(F.col(MONTH), F.lit("-01"))).alias("date")
        return rows.select(*KEYS, dated, F.lit(None).cast("bigint").alias("move_id"), *[sides[s].alias(s) for s in SIDES])


def with_cube(tables: Tables, cube: BalanceCube) -> Tables:
    """The tables with month balances, which the reports then use for what lies before their window."""
    return tables.having(cube=cube)


def lines_until(tables: Tables, date_from: date, date_to: date, net: bool = True) -> DataFrame:
    """What a report with a window sums: the lines of all months up to its end, older ones by their month balances.

    Without balances these are the lines. With them, lines are read from the month of ``date_from`` on, or from the first
    open month if that is earlier, and have the columns that sums need.
    """
    lines, cube = tables["account_move_line"], tables.cube
    if cube is None:
        return in_months(lines, None, date_to)
    first_open = min(date_from.replace(day=1), cube.closed)
    recent = in_months(lines, first_open, date_to).filter(F.col("date") >= day(first_open))
    return recent.select(*KEYS, "date", "move_id", *SIDES).unionByName(cube.before(first_open, net))


def store_cube(lines: DataFrame, table: str, closed: date) -> None:
    """Store the balances of all months before ``closed``."""
    rows = month_balances(lines.filter(F.col("date") < day(closed)))
    rows.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).saveAsTable(table)
    _set_closed(lines.sparkSession, table, closed)


def close_months(lines: DataFrame, table: str, closed: date) -> None:
    """Add the months from the first open one up to ``closed``; older lines aren't read.

    Readers use a month only once it is named as closed, after it is written. A run that stops in between is repeated:
    months are written whole.
    """
    spark = lines.sparkSession
    known = closed_until(spark, table)
    if closed <= known:
        return
    last = date.fromordinal(closed.toordinal() - 1)
    fresh = in_months(lines, known, last).filter((F.col("date") >= day(known)) & (F.col("date") < day(closed)))
    replace_partitions(month_balances(fresh).hint("rebalance", MONTH), table)
    _set_closed(spark, table, closed)


def closed_until(spark: SparkSession, table: str) -> date:
    (row,) = spark.sql(f"SHOW TBLPROPERTIES {table} ('{CLOSED}')").collect()
    return date.fromisoformat(row["value"])


def _set_closed(spark: SparkSession, table: str, closed: date) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{CLOSED}' = '{closed.isoformat()}')")


def read_cube(spark: SparkSession, table: str) -> BalanceCube:
    closed = closed_until(spark, table)
    return BalanceCube(spark.table(table), closed)

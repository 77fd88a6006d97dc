"""Filters shared by the reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Ids


#: Partition column of stored ledger lines.
ENTRY_MONTH = "entry_month"
#: Its value for lines that have no month in common with their entry.
OTHER_MONTH = "other"


def day(value: date) -> Column:
    return F.lit(value).cast("date")


def keep_ids(df: DataFrame, column: str, ids: Ids) -> DataFrame:
    """Optional IN filter. A DataFrame of ids becomes a semi join; Spark picks its strategy by size."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("_wanted"))
        return df.join(wanted, df[column] == F.col("_wanted"), "left_semi")
    return df.filter(F.col(column).isin(*ids)) if ids else df


def in_window(column: Column, start: date, end: date) -> Column:
    """Both ends included."""
    return column.between(day(start), day(end))


def in_months(lines: DataFrame, start: date | None, end: date) -> DataFrame:
    """Lines of the months of a window, where they are stored by month; else all lines.

    Lines with another date than their entry are always among them. The months only save reading others; the dates still
    decide.
    """
    if ENTRY_MONTH not in lines.columns:
        return lines
    month = F.col(ENTRY_MONTH)
    inside = month <= end.strftime("%Y-%m")
    if start is not None:
        inside = inside & (month >= start.strftime("%Y-%m"))
    return lines.filter(month.isNotNull() & (inside | (month == OTHER_MONTH)))


def after_until(column: Column, start: date, end: date) -> Column:
    """The analysis screens leave the first day out."""
    return (column > day(start)) & (column <= day(end))


def between_moments(df: DataFrame, column: str, start, end) -> DataFrame:
    """Optional inclusive bounds on a timestamp column."""
    kind = df.schema[column].dataType
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(str(start)).cast(kind))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(str(end)).cast(kind))
    return df

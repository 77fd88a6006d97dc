"""Comparing a report with its SQL counterpart, whatever the order of the rows."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _source(sf_dir: str, table: str) -> str:
    path = f"{sf_dir}/{table}.parquet"
    return f"read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"read_parquet('{path}')"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in STAR:
        con.execute(f"create view {table} as select * from {_source(sf_dir, table)}")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(report: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else a short account of what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(report.columns):
        return f"columns {sorted(report.columns)} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    ours_types = {f.name: _TYPES.get(f.dataType.simpleString()) for f in report.schema.fields}
    if ours_types != types:
        return f"types {[(n, ours_types[n], types[n]) for n in types if types[n] != ours_types[n]]}"
    ours, theirs = _rows(report.columns, report.collect()), _rows(names, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
    return (
        f"{len(ours)} vs {len(theirs)} rows; columns {sorted(names)}\nonly report: {only_ours}\n"
        f"only sql: {only_theirs}\n{types}"
    )

"""A copy of the test tables in which single keys hold a third of all rows."""

from __future__ import annotations

import os

import duckdb

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def write_skewed(sf_dir: str, target: str, files: int = 1) -> str:
    """One hot order, product, supplier, customer and day. Returns ``target``."""
    con = duckdb.connect()
    hot = con.execute(
        f"""select o_orderkey from '{sf_dir}/orders.parquet'
            where o_orderstatus = 'F' and o_orderpriority = '3-MEDIUM' and o_orderdate between '1998-02-01' and '1998-11-30'
            order by o_orderkey limit 1"""
    ).fetchone()[0]
    changed = {
        "orders": f"""select o_orderkey,
                case when o_orderkey % 3 = 0 or o_orderkey = {hot} then 1 else o_custkey end as o_custkey,
                o_orderstatus, o_totalprice,
                case when o_orderkey % 3 = 1 and o_orderkey <> {hot} then timestamp '1998-05-05' else o_orderdate end
                    as o_orderdate,
                o_orderpriority from '{sf_dir}/orders.parquet'""",
        "lineitem": f"""select case when n % 3 = 0 then {hot} else l_orderkey end as l_orderkey,
                case when n % 3 = 1 then 2 else l_partkey end as l_partkey,
                case when n % 3 = 2 then 3 else l_suppkey end as l_suppkey,
                l.* exclude (l_orderkey, l_partkey, l_suppkey, n)
            from (select *, row_number() over () as n from '{sf_dir}/lineitem.parquet') l""",
    }
    for table in STAR:
        sql = changed.get(table, f"select * from '{sf_dir}/{table}.parquet'")
        path = f"{target}/{table}.parquet"
        if table == "lineitem" and files > 1:
            os.makedirs(path)
            con.execute(f"create temp table lines as select *, row_number() over () % {files} as f from ({sql}) s")
            for f in range(files):
                con.execute(f"copy (select * exclude f from lines where f = {f}) to '{path}/part {f}.parquet'")
        else:
            con.execute(f"copy ({sql}) to '{path}'")
    return target

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.hierarchy import ancestors, below, child_of, group_members, rolled_up


def nodes(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None), (5, 99)], "id bigint, parent_id bigint")


def test_ancestors(spark):
    assert sorted(tuple(r) for r in ancestors(nodes(spark)).collect()) == [
        (1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 4), (5, 5)
    ]


def test_child_of_keeps_the_node_and_all_below(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, None)], "node bigint")
    assert sorted(r.node for r in child_of(rows, "node", nodes(spark), (2,)).collect()) == [2, 3]
    assert sorted(r.node for r in child_of(rows, "node", nodes(spark), (1, 2, 4)).collect()) == [1, 2, 3, 4]
    assert child_of(rows, "node", nodes(spark), (77,)).count() == child_of(rows, "node", nodes(spark), ()).count() == 0


def test_random_trees_against_walking_up(spark):
    pick = random.Random(3)
    parent = {n: pick.choice([None, 0, pick.randrange(1, n)] if n > 1 else [None]) for n in range(1, 300)}
    table = spark.createDataFrame(list(parent.items()), "id bigint, parent_id bigint")

    def up(n):
        while n in parent:
            yield n
            n = parent[n]

    assert {tuple(r) for r in ancestors(table).collect()} == {(n, a) for n in parent for a in up(n)}
    assert {r.id for r in below(table, (3, 8)).collect()} == {n for n in parent if {3, 8} & set(up(n))}
    values = [(n, n * 10) for n in parent if n % 3 == 0] + [(3, 5), (10_000, 1)]
    sums = {}
    for n, v in values:
        for a in up(n):
            sums[a] = sums.get(a, 0) + v
    got = rolled_up(table, spark.createDataFrame(values, "id bigint, v bigint"), ["v"])
    assert {r.id: r.v for r in got.collect()} == sums


def test_a_chain_of_ten_thousand(spark):
    chain = spark.range(10_000).selectExpr("id", "IF(id > 0, id - 1, NULL) AS parent_id")
    assert below(chain, (2_500,)).count() == 7_500
    sums = rolled_up(chain, chain.selectExpr("id", "1.5BD AS v"), ["v"])
    assert sums.filter("v <> (10000 - id) * 1.5BD").count() == 0 and sums.count() == 10_000


def test_a_million_children_of_one_node(spark):
    wide = spark.range(1_000_001).selectExpr("id", "IF(id > 0, 0L, NULL) AS parent_id")
    assert below(wide, (0,)).count() == 1_000_001
    top = rolled_up(wide, wide.select("id", F.lit(1).alias("v")), ["v"]).filter("id = 0").first()
    assert top.v == 1_000_001


def test_a_cycle_is_an_error(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None)], "id bigint, parent_id bigint")
    for search in (lambda: ancestors(table), lambda: below(table, (5,)), lambda: rolled_up(table, table.selectExpr("id", "1 AS v"), ["v"])):
        with pytest.raises(ValueError, match="cycle"):
            search()
    own = spark.createDataFrame([(1, 1)], "id bigint, parent_id bigint")
    with pytest.raises(ValueError, match="cycle"):
        ancestors(own)


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, parent_id bigint")
    assert ancestors(none).count() == below(none, (1,)).count() == 0


def test_group_members_by_prefix(spark):
    accounts = spark.createDataFrame([(1, "1435"), (2, "15"), (3, "")], "id bigint, code string")
    groups = spark.createDataFrame([(1, "1"), (2, "14"), (3, "1435"), (4, "")], "id bigint, code string")
    pairs = group_members(accounts, groups).select("account_id", "group_id").collect()
    assert sorted(tuple(r) for r in pairs) == [(1, 1), (1, 2), (1, 3), (2, 1)]

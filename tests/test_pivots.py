from folioflow.operators import pivots


def sample(spark):
    return spark.createDataFrame([("a", 1, 2.0), ("a", None, 3.0), ("b", 1, 4.0)], "k string, c bigint, m double")


def test_cells_rows_columns_and_grand_total(spark):
    rows = pivots.pivot_cells(sample(spark), ["k"], ["c"], ["m"]).collect()
    assert sorted((str(r.k), str(r.c), r.total_k, r.total_c, r.m) for r in rows) == sorted([
        ("a", "1", False, False, 2.0), ("a", "None", False, False, 3.0), ("b", "1", False, False, 4.0),
        ("a", "None", False, True, 5.0), ("b", "None", False, True, 4.0),
        ("None", "1", True, False, 6.0), ("None", "None", True, False, 3.0), ("None", "None", True, True, 9.0),
    ])


def test_groups_nest(spark):
    rows = pivots.pivot_groups(sample(spark), ["k", "c"], ["m"]).collect()
    assert len(rows) == 6
    assert [r.m for r in rows if r.total_k] == [9.0]


def test_wide(spark):
    rows = pivots.pivot_table(sample(spark), ["k"], "c", [1, 2], "m").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", 2.0, None), ("b", 4.0, None)]


def test_footers(spark):
    report = pivots.report_footers({"one": (sample(spark), ["m"])})
    assert [(r.report, r.measure, float(r.total)) for r in report.collect()] == [("one", "m", 9.0)]


def test_distinct_keys_are_counted_once_in_totals(spark):
    rows = [(k % 3 if k % 7 else None, "ab"[k % 2], (k * 37) % 100 - 20 + 40_000 * (k % 4)) for k in range(600)] + [(9, "z", None)]
    df = spark.createDataFrame(rows, "r int, c string, k bigint")
    want = {}
    for r, c, k in rows:
        for key in ((r, c, False, False), (r, None, False, True), (None, c, True, False), (None, None, True, True)):
            want.setdefault(key, set()).add(k)
    want = {key: len(found - {None}) for key, found in want.items()}
    got = pivots.pivot_distinct(df, ["r"], ["c"], "k", "n").collect()
    assert {(x.r, x.c, x.total_r, x.total_c): x.n for x in got} == want and len(got) == len(want)

import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import negatives


def plain(rows):
    """Every anchor against every row, sorted."""
    clean = []
    for k, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((k, vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for k, anchor, label, v in clean:
        if anchor % 100:
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), i, own) for j, i, own, w in clean if j != k and len(w) == len(v)]
        others.sort(key=lambda x: (-x[0], x[1]))
        for score, positive, _ in [x for x in others if x[2] == label][:5]:
            hard = [x for x in others if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score][:5]
            out += [(anchor, positive, rank, i, score, s) for rank, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def ours(spark, rows, **extra):
    docs = spark.createDataFrame([(i, v, c) for i, v, c in rows], "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1)).withColumn("row", F.lit("own")).withColumn("a.b", F.lit(1)).repartition(4)
    return sorted(tuple(r) for r in negatives.report(docs).collect())


def some(n, dim, seed, labels=10):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(k, [x + pick.gauss(0, 0.3) for x in pick.choice(centres)], pick.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("block", [40, 4_000_000])
def test_by_sorting(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block * 4)
    monkeypatch.setattr(negatives, "TILE", block * 3)
    rows = some(900, 4, 1)
    rows += [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0], 1), (2002, [1.0, math.nan, 1.0, 1.0], 1), (2003, [math.inf, 1.0, 1.0, 1.0], 1), (2100, [1.0] * 4, None), (None, [1.0] * 4, 2)]
    assert ours(spark, rows) == plain(rows) != []


def test_ties_go_by_vec_id(spark):
    rows = [(k, [0.5, 0.25], k % 3) for k in range(400)]
    assert ours(spark, rows) == plain(rows) != []


def test_negative_and_zero_scores(spark):
    rows = [(100, [1.0, 0.0], 1), (101, [-1.0, 0.0], 1), (102, [0.0, 1.0], 1), (103, [0.0, -1.0], 2), (104, [-1.0, 3.0], 2), (200, [0.0, 0.0], 3), (201, [1.0, 1.0], 3)]
    assert ours(spark, rows) == plain(rows) != []


def test_large_components_and_lengths(spark):
    rows = some(300, 3, 5, labels=2) + [(1000 + k, v, c) for k, v, c in some(200, 7, 6, labels=2)] + [(5000, [], 1), (5001, [], 1), (5002, [], 2)]
    large = [(k, [x * 3e5 for x in v], c) for k, v, c in rows]
    assert ours(spark, rows) == plain(rows) != []
    assert ours(spark, large) == plain(large) != []


def test_repeated_rows(spark):
    rows = some(150, 3, 9, labels=2)
    rows += [rows[100], rows[100], rows[3]]
    # Each repeated anchor is asked for; its copies are other rows of its label.
    assert ours(spark, rows) == plain(rows) != []


def test_empty(spark):
    assert ours(spark, []) == [] and ours(spark, [(100, [1.0], 1)]) == []
    assert ours(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []


def test_suffix_merges(spark):
    found = [(1, 0, 10, 1, 1), (1, 0, 9, 2, 2), (1, 1, 8, 3, 3), (1, 1, 8, 1, 4), (1, 2, 7, 5, 5), (1, 2, 6, 6, 6)]
    got = negatives.suffix_merges(spark.createDataFrame(found, "anchor long, slot int, score long, vec_id long, row long"), 3, 4).first().tops
    assert [[x.row for x in top] for top in got] == [[1, 2, 4], [4, 3, 5], [5, 6], []]

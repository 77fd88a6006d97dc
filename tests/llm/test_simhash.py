import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.llm import simhash
from folioflow.llm.queries import op6_simhash


def plain_fingerprint(text):
    """Bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, bits=4):
    """All pairs."""
    keys = sorted(set(prints))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def plain(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    first = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    return sorted(((i, f"{p:016x}", first.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


TEXTS = ["", None, " \n", "one", "One", "a b c", "a b c d", "A B C D", "a b c d e", "x y z w v", "a\x0bb\x0cc d e f", "É b c d e", "w " * 5000, "ß straße " * 40, "a\x1cb c d e"]


def test_fingerprints_bit_by_bit():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("hot", [1024, 3])
def test_components_by_all_pairs(spark, hot):
    """``hot`` of 3 sends all but the smallest groups through the wider table."""
    rng = random.Random(7)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(4, "One"), (None, "one"), (None, "no id has this")]
    for base in range(6):
        words = [f"v{rng.randrange(900)}" for _ in range(200)]
        rows += [(100 + 50 * base + k, near(rng, words, k % 4)) for k in range(25)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, print=1, component_id="x", node=2) for i, t in rows]).repartition(4)
    found = sorted((tuple(r) for r in simhash.report(docs, hot=hot).collect()), key=str)
    assert found == plain(rows)
    kept = {r.doc_id for r in simhash.one_of_each(docs, hot=hot).collect()}
    assert kept == {c for _, _, c in plain(rows)} - {None} | {None}


@pytest.mark.parametrize("hot", [1024, 3])
def test_links_of_planted_fingerprints(spark, hot):
    """Chains of exactly four bits and pairs at five, over both halves."""
    rng = random.Random(1)
    values = [0]
    for _ in range(40):
        p = rng.getrandbits(64)
        for step in (4, 5, 3, 4, 5):
            values.append(p)
            for b in rng.sample(range(64), step):
                p ^= 1 << b
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    prints = spark.createDataFrame([(v,) for v in set(signed)], "print long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints, hot)).collect()}
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(v)
    expected = {}
    for v, r in plain_components(values).items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_tasks_are_cut_by_entries(spark):
    """However few files have the fingerprints, a task makes about as many entries as the limit says."""
    values = [random.Random(k).getrandbits(63) for k in range(4000)]
    prints = simhash.keep(spark.createDataFrame([(v,) for v in values], "print long").coalesce(1), "prints")
    found = simhash.entered(prints, simhash.ball_entries, 66, 66 * 400)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 66 * len(set(values)) and len(sizes) == 10 and max(sizes) < 2 * 66 * 400
    kept = []
    real = simhash.keep
    try:
        simhash.keep = lambda df, name: kept.append(df) or real(df, name)
        simhash.links(prints)
    finally:
        simhash.keep = real
    assert all("RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString() for df in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.report(docs).collect() == [] and simhash.one_of_each(docs).columns == docs.columns


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op6_simhash(spark, sf_dir).collect()), key=str) == plain(rows)


def test_one_row_of_each_component_without_or_with_equal_ids(spark):
    """Different texts under a null doc_id and under equal doc_ids all stay; of near-duplicates one row does, the same on every run."""
    rng = random.Random(3)
    words = lambda: [f"v{rng.randrange(10**6)}" for _ in range(300)]
    single = [(i, " ".join(words()), "s") for i in [None] * 40 + [7] * 20 + [8]]
    copies = [(None, " ".join(words()), "s")] * 3
    mixed = " ".join(words())
    base = words()
    close = sorted({" ".join([*base[:k], *base[k + 1 :]]) for k in range(0, 300, 60)} | {" ".join(base)})
    groups = plain_components([plain_fingerprint(t) for t in close])
    kept_close = [(9, min(t for t in close if groups[plain_fingerprint(t)] == root), "s") for root in set(groups.values())]
    rows = single + copies + [(None, mixed, "a"), (7, mixed, "z"), (7, mixed, "b"), (11, mixed, "a")] + [(9, t, "s") for t in close]
    expected = sorted([*single, copies[0], (7, mixed, "b"), *kept_close], key=str)
    for parts in (5, 2):
        docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string, source string").repartition(parts)
        found = simhash.one_of_each(docs)
        assert found.columns == docs.columns
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected

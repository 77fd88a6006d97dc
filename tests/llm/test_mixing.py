import hashlib
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.llm import mixing


def place(doc_id):
    return int(hashlib.md5(f"{mixing.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows, most=3):
    """Targets by repeated sharing, then a walk along the seeded order of each source."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target = {}
    while len(target) < len(sources):
        left = sum(words.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in sources if x not in target) for s in sources if s not in target}
        over = {s: float(most * words[s]) for s in share if share[s] > most * words[s]}
        target |= over or share
    out = []
    for s in sources:
        take = min(round(target[s]), most * words[s])
        passes, need = divmod(take, words[s]) if words[s] else (0, 0)
        groups = {}
        for doc_id, text, x in rows:
            if x == s:
                groups.setdefault(place(doc_id), []).append((doc_id, size(text)))
        so_far = 0
        for at in sorted(groups):
            n = sum(k for _, k in groups[at])
            more = need > 0 and 2 * so_far + n <= 2 * need and (so_far < need or not n)
            so_far += n
            out += [(doc_id, k, words[s], target[s], k * (passes + more)) for doc_id, k in groups[at]]
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", "b", "b", "É", "", None, "z"])) for k in range(400)]
    return rows + [(3, "twice\x0bmore\x1cover", "a"), (None, "no id", "b"), (500, None, "a"), (501, "", "only empty"), (502, " \t\n", "only empty"), (503, "w " * 3000, "z"), (504, "tiny", "big weight")]


def test_by_a_walk_along_the_order(spark):
    rows = made()
    docs = spark.createDataFrame([Row(doc_id=i, text=t, source=s, size=9, pattern="x", target=0, u=1) for i, t, s in rows]).repartition(5)
    found = mixing.mix(docs)
    again = mixing.mix(docs.repartition(2))
    shown = sorted((tuple(r) for r in found.collect()), key=str)
    expected = plain(rows)
    assert [r[:3] + r[4:] for r in shown] == [r[:3] + r[4:] for r in expected]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(shown, expected, strict=True))
    assert shown == sorted((tuple(r) for r in again.collect()), key=str)
    assert all(r[4] <= 3 * r[1] for r in shown)
    taken = sorted((tuple(r) for r in mixing.mixed_documents(docs).collect()), key=str)
    assert sum(size(r[1]) for r in taken) == sum(r[4] for r in shown) and mixing.mixed_documents(docs).columns == docs.columns


def test_overlapping_sources(spark):
    """Documents of both sources fill whichever target needs them, before any is repeated."""
    rows = [(k, "w " * 10, ["a"]) for k in range(10)] + [(100 + k, "w " * 10, ["b", "a"]) for k in range(30)] + [(200 + k, "w " * 10, ["b", "b"]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    _, decided, words, wanted = mixing.decide(docs, members=F.col("of"))
    assert words == {"a": 400, "b": 350} and wanted == {"a": 150.0, "b": 300.0}
    assert sorted((r.pattern, r.passes, r["last"]) for r in decided.collect()) == [(["a"], 1, -1), (["a", "b"], 1, -1), (["b"], 1, -1)]


def test_mix_has_a_row_for_every_pattern(spark):
    """Documents of one, several, null and no sources: none goes, and each has the numbers of its own sources."""
    rows = [(k, "w " * 10, ["a"]) for k in range(10)] + [(100 + k, "w " * 10, ["b", "a"]) for k in range(30)] + [(200 + k, "w " * 10, ["b", "b"]) for k in range(5)]
    rows += [(300, "w " * 10, [None, "a"]), (301, "w w", []), (302, "w w w", None), (None, "w", ["c", None, "b"]), (None, "w", ["c", None, "b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>").repartition(3)
    _, _, words, wanted = mixing.decide(docs, members=F.col("of"))
    assert words == {"a": 410, "b": 352, "c": 2, None: 12}
    found = mixing.mix(docs, members=F.col("of")).collect()
    known = {r.doc_id: r for r in found}
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    for doc_id, text, of in rows:
        own = sorted(set(of or []), key=lambda s: (s is None, s or ""))
        r = known[doc_id]
        assert (r.sources, r.size, r.source_size, r.target) == (own, size(text), [words[s] for s in own], [wanted[s] for s in own])
        assert 0 <= r.taken <= 3 * r.size and (own or r.taken == 0)
    taken = mixing.mixed_documents(docs, members=F.col("of")).collect()
    assert sum(size(r.text) for r in taken) == sum(r.taken for r in found) > 0
    empty = mixing.mix(docs.limit(0), members=F.col("of"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "sources", "size", "source_size", "target", "taken"]


@pytest.mark.parametrize(("patterns", "wanted", "expected"), [
    ({("a",): 10}, {"a": 10.0}, {("a",): 10}), ({("a",): 10}, {"a": 25.0}, {("a",): 25}), ({("a",): 10}, {"a": 90.0}, {("a",): 30}),
    ({("a",): 10, ("a", "b"): 10}, {"a": 15.0, "b": 5.0}, {("a",): 10, ("a", "b"): 10}), ({("a",): 0}, {"a": 0.0}, {("a",): 0}),
    # The second pass over either costs the same as long as no third is needed.
    ({("a",): 10, ("b",): 10, ("a", "b"): 4}, {"a": 20.0, "b": 20.0}, {("a",): 16, ("b",): 16, ("a", "b"): 8}),
])
def test_flow(patterns, wanted, expected):
    found = mixing.flow(patterns, wanted, 3)
    cost = lambda taken: sum(max(0, t - n) + max(0, t - 2 * n) for t, n in ((taken[p], patterns[p]) for p in patterns))
    assert sum(found.values()) == sum(expected.values()) and cost(found) == cost(expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.mixed_documents(docs).collect() == []


def test_stage_keeps_columns_of_any_name(spark):
    names = ("_own", "_place", "_pattern", "_again", "_passes", "pattern", "u", "passes", "a.b")
    docs = spark.createDataFrame([(k, "w " * 5, "ab"[k % 2], *range(9)) for k in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == 20 and taken.filter("`a.b` = 8 and _own = 0 and u = 6").count() == 20
    nulls = spark.createDataFrame([(None, None, None), (1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mixed_documents(nulls).columns == nulls.columns


def test_many_sources_that_share_nothing(spark):
    import time

    start = time.monotonic()
    patterns = {(f"s{k}",): 10 + k % 7 for k in range(100_000)} | {("s1", "s2"): 50, ("s2", "s3"): 5}
    wanted = {f"s{k}": 25.0 for k in range(100_000)}
    taken = mixing.flow(patterns, wanted, 3)
    assert time.monotonic() - start < 10
    assert taken[("s9",)] == 25 and sum(taken[p] for p in patterns if p[0] in ("s1", "s2", "s3")) == 75
    assert list(mixing.flow(dict(reversed(patterns.items())), wanted, 3).items()) != [] and mixing.flow(dict(reversed(patterns.items())), wanted, 3) == taken

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from folioflow.llm import suffixes
from folioflow.llm.queries import op2_suffix_dedup


def plain(rows, length=100):
    """Every string of every document in order, in a set."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            own = raw[i : i + length]
            if own in seen:
                gone[i : i + length] = True
            seen.add(own)
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    assert suffixes.PERIOD - 1 + suffixes.SAMPLE == suffixes.LENGTH


def test_packing():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64)):
        assert (suffixes.unascending(suffixes.ascending(values)) == values).all()
        edges = suffixes.bucket_edges(values, 7)
        assert edges[0] == 0 and edges[-1] == len(values) and (np.diff(edges) >= 0).all()
        for chosen in (range(0, 3), range(3, 7), range(2, 2)):
            inside = suffixes.in_buckets(values, 7, chosen)
            assert (inside == [any(edges[b] <= k < edges[b + 1] for b in chosen) for k in range(len(values))]).all()


def made(seed):
    """Shared passages of about the least length at every offset, runs of one letter, copies, near copies, short texts."""
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdefghij é\n") for _ in range(n))

    passages = [text(n) for n in (90, 97, 99, 100, 101, 120, 155, 156, 157, 400)]
    rows = []
    for k in range(70):
        parts = [text(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(passages), text(rng.randint(0, 3))]
        rows.append((k * 3, "".join(parts)))
    long = text(3000)
    rows += [(500 + k, long[: 300 * k] + "#" + long[300 * k :]) for k in range(6)]
    rows += [(600, "z" * 250), (601, "z" * 99), (602, "z" * 100), (603, "zy" * 200), (604, ""), (605, None), (606, long), (7, long), (607, long[50:149]), (608, long[50:150])]
    rows += [(610 + k, "The licence that many have. " * 4) for k in range(40)] + [(-9, "é" * 60), (None, passages[9])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "entries", "rounds"), [(4 << 20, 1 << 20, 3), (2000, 500, 2), (1, 100, 1)])
def test_by_a_set_of_all_strings(spark, block, entries, rounds):
    rows = made(block)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, block=1, bits="x", n_bytes=0) for i, t in rows]).repartition(3)
    assert found(suffixes.repeats(docs, block, entries, rounds)) == plain(rows)


def test_order_of_colliding_fingerprints():
    h, second = np.array([7, 5, 7, 7, 5], np.uint64), np.array([2, 9, 1, 2, 9], np.uint64)
    order, first = suffixes.distinct(h, second)
    assert order.tolist() == [1, 4, 2, 0, 3] and first.tolist() == [True, False, True, True, False]


@pytest.mark.parametrize("name", ["VALUES", "SECOND_VALUES"])
def test_strings_that_collide_in_a_fingerprint_stay_apart(spark, monkeypatch, name):
    """A fingerprint that can't tell the letters a to e apart."""
    blind = getattr(suffixes, name).copy()
    blind[ord("a") : ord("e") + 1] = blind[ord("a")]
    monkeypatch.setattr(suffixes, name, blind)
    rng = random.Random(3)

    def turned(text):
        return "".join(rng.choice("abcde") if c in "abcde" else c for c in text)

    base = made(5)
    rows = base + [(1000 + k, turned(t) if k % 2 else t) for k, (_, t) in enumerate(base) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(suffixes.repeats(docs, 3000, 700, 2)) == plain(rows)


def test_empty_and_short_tables(spark):
    assert found(suffixes.repeats(spark.createDataFrame([], "doc_id long, text string"))) == []
    rows = [(1, None), (2, ""), (3, "short")]
    assert found(suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_repeated_rows_are_removed_once(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef") for _ in range(500))
    docs = spark.createDataFrame([(4, text)] * 3, "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.repeats(docs).collect()) == [0, 500, 500]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op2_suffix_dedup(spark, sf_dir)) == plain(rows)

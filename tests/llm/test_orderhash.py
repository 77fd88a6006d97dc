import hashlib
import random

import pytest
from pyspark.sql import Row

from folioflow.llm import orderhash
from folioflow.llm.queries import op5_order_minhash


def plain_sketch(text):
    """Sort all numbered k-mers under every order."""
    k = min(orderhash.K, len(text))
    hashes = orderhash.numbered(text).tolist()
    kmers = [text[i : i + k] for i in range(len(text) - k + 1)] if text else []
    assert len(hashes) == len(kmers)
    names, seen = {}, {}
    for kmer, h in zip(kmers, hashes, strict=True):
        seen[kmer] = number = seen.get(kmer, -1) + 1
        assert names.setdefault((kmer, number), h) == h
    assert len(set(names.values())) == len(names) == len(kmers)
    out = []
    for order in orderhash.ORDERS[: orderhash.SKETCHES].tolist():
        least = sorted(range(len(hashes)), key=lambda i: hashes[i] * order % 2**64)[: orderhash.L]
        out.append(tuple(hashes[i] for i in sorted(least)))
    return out


def plain(rows):
    """The list in order, each with the one below it."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = plain_sketch(text), plain_sketch(new), plain_sketch(after)
        same = [sum(x == y for x, y in zip(a, z, strict=True)) / len(a) for z in (b, c)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *same))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()), key=str)


TEXTS = ["", None, "a", "ab", "abcdefgh", "abcdefghi", "🙂é日本語x" * 3, "aaaaaaaaaaaaaaaaaaaaaaa", "word " * 2500, "the cat sat on the mat " * 9]


@pytest.mark.parametrize("rows_per_task", [1, 3, 4096])
def test_neighbours_and_likeness(spark, monkeypatch, rows_per_task):
    rng = random.Random(5)
    rows = [(k * 3 - 4, t) for k, t in enumerate(TEXTS)] + [(None, "without id"), (None, None), (5, "twice"), (5, "again"), (5, "again")]
    rows += [(1000 + k, " ".join(rng.choice(["ab", "cde", "f"]) for _ in range(60))) for k in range(12)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, shard=1, task=2, to="x") for i, t in rows]).repartition(3)
    monkeypatch.setattr(orderhash, "DOCS_PER_TASK", rows_per_task)
    found = orderhash.fingerprints(docs, rows_per_task)
    found = [(r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.near_edited, r.near_next) for r in found.collect()]
    assert sorted(found, key=str) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(7, "alone in here")], [(None, "alone in here")], [(2, "a b c"), (1, "a b c")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(orderhash.report(docs)) == plain(rows)


def test_equal_texts_have_equal_fingerprints_and_order_counts():
    a, b = "abcdefghijklmnop" * 20, "ponmlkjihgfedcba" * 20
    words = [f"word{k:04d} " for k in range(300)]
    forward, swapped = "".join(words), "".join(words[150:] + words[:150])
    assert (orderhash.sketch(a) == orderhash.sketch(str(a))).all()
    assert orderhash.likeness(orderhash.sketch(a), orderhash.sketch(b)) == 0
    # The same words in another order: nearly all k-mers are shared, about half of the pairs change places.
    assert 0.25 < orderhash.likeness(orderhash.sketch(forward), orderhash.sketch(swapped)) < 0.75


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = shown(op5_order_minhash(spark, sf_dir))
    few = [(i, t) for i, t in rows if len(t or "") < 1200]
    assert len(found) == len(rows)
    told = {r[0]: r for r in plain(rows)} if len(few) == len(rows) else None
    by_id = {r[0]: r for r in found}
    order = sorted(rows, reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert by_id[doc_id][:3] == (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest())
    assert told is None or [told[r[0]] for r in found] == found

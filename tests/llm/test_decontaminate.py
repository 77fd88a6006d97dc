import hashlib
import pickle
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from folioflow.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, bench, width=10):
    """Every window of every item at every place of every document."""
    out = []
    for doc_id, text in rows:
        own, hit, ids = words(text), set(), set()
        for item, t in bench:
            w = words(t)
            n = min(width, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == w[k : k + n]:
                        hit.update(range(i, i + n))
                        ids.add(item)
        # An item without an id counts, but isn't named.
        sha = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def made():
    rng = random.Random(11)
    line = [f"w{k}" for k in range(60)]
    bench = [(1, " ".join(line[:30])), (2, "Short, item!"), (3, "one"), (4, ""), (5, None), (10, " ".join(line[5:15])), (5, " ".join(line[40:52])), (2, "again short item"), (None, "no id at all")]
    docs = [(1, " ".join(line)), (2, " - ".join(line[3:14]).upper()), (3, " ".join(line[3:12])), (4, "a short item"), (5, "ONE"), (6, ""), (7, None), (8, "oné one1 One"), (8, "twice one"), (None, "No id, at: all")]
    for k in range(30):
        docs.append((20 + k, " ".join(rng.choice([*line[:4], " ".join(line[6:17]), "short item", "É", "!"]) for _ in range(40))))
    # Words across two documents are no window.
    docs += [(60, " ".join(line[20:25])), (61, " ".join(line[25:30])), (62, "x " * 20_000 + " ".join(line[:11]))]
    return docs, bench


@pytest.mark.parametrize("limit", [8 << 20, 150])
def test_by_every_place(spark, limit):
    """The lower limit cuts the benchmark into several blocks, scanned one after another."""
    docs, bench = made()
    d = spark.createDataFrame([Row(doc_id=i, text=t, _text="own", n_words=1, item_id=2) for i, t in docs]).repartition(3)
    b = spark.createDataFrame([Row(item_id=i, text=t, lang="en") for i, t in bench])
    expected = plain(docs, bench)
    assert sorted((tuple(r) for r in decontaminate.report(d, b, limit=limit).collect()), key=str) == expected
    d = d.withColumns({"_hits": decontaminate.F.lit(1), "a.b`c": decontaminate.F.lit("x"), "_c0": decontaminate.F.lit(0)})
    kept = decontaminate.decontaminate(d, b, limit=limit)
    assert kept.columns == d.columns == ["doc_id", "text", "_text", "n_words", "item_id", "_hits", "a.b`c", "_c0"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in expected if not r[5])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.report(docs, bench).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.report(docs.limit(0), bench).collect() == []


def found_in(block, texts):
    matcher = decontaminate.Matcher(block)
    hits, before = matcher.hits(pa.array(texts, pa.string()))
    out = [(set(), set()) for _ in texts]
    for i, n, k in hits:
        row = int(np.searchsorted(before, i, side="right")) - 1
        out[row][0].update(range(i - int(before[row]), i - int(before[row]) + n))
        out[row][1].update(matcher.items({(n, k)}))
    return [(len(a), len(b)) for a, b in out]


def test_windows_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    docs, bench = made()
    real = decontaminate.polynomial
    monkeypatch.setattr(decontaminate, "polynomial", lambda *a: real(*a) % np.uint64(5) << np.uint64(61))
    docs = [d for d in docs if d[0] != 62]
    bench = [(k, t) for k, (_, t) in enumerate(bench)]
    block = decontaminate.windows(pa.table({"item_id": [i for i, _ in bench], "text": pa.array([t for _, t in bench], pa.string())}))
    assert all(len(set(keys.tolist())) <= 5 for keys, *_ in block["tables"].values())
    expected = {r[0:4:1] for r in ((k, *x[1:4]) for k, d in enumerate(docs) for x in plain([d], bench))}
    assert {(k, len(words(d[1])), *f) for (k, d), f in zip(enumerate(docs), found_in(block, [t or "" for _, t in docs]), strict=True)} == expected


def test_a_whole_block_takes_bounded_memory():
    """8 MB of different windows; a third of the items share one passage."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{k}" for k in range(40))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) + (" " + shared if k % 3 == 0 else "") for k in range(9_000)]
    items = pa.table({"item_id": range(len(texts)), "text": texts})
    assert sum(map(len, texts)) > 7 << 20
    tracemalloc.start()
    start = time.monotonic()
    block = decontaminate.windows(items)
    seconds, most = time.monotonic() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 << 20 and len(pickle.dumps(block)) < 48 << 20 and seconds < 60
    assert found_in(block, [shared, texts[7], "w1 " + texts[9]]) == [(40, 3_000), (100, 1), (140, 3_000)]


def test_long_items_in_parts_and_rows_without_an_id(spark):
    """Parts of a text have its windows and no others; equal rows and rows without an id don't pile up in a block."""
    rng = random.Random(5)
    text = [f"v{rng.randrange(300)}" for _ in range(3_000)]
    bench = [(1, " ".join(text)), *((None, f"{k} " + " ".join(text[k : k + 12])) for k in range(50)), *[(2, "just nine words are too few to be cut")] * 100]
    docs = [(k, " ".join(text[a : a + 25])) for k, a in enumerate(range(0, 2_990, 130))] + [(90, " ".join(text[:9])), (91, "JUST nine words, are too few to be cut!")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert len(decontaminate.blocks(b, 4_000)) > 4
    expected = plain(docs, [(i, t) for i, t in bench if i is not None])
    got = sorted((tuple(r) for r in decontaminate.report(d, b, limit=4_000).collect()), key=str)
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in got] == [(r[0], r[1], r[2], r[4], r[5]) for r in expected]

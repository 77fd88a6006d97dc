import hashlib
import re

import pytest
from pyspark.sql import Row

from folioflow.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, keep_first=False):
    """A dictionary of keys to documents, then one text at a time."""
    split = [(t or "").split("\n") for _, t in rows]
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in own] for own in split]
    have = {}
    for k, own in enumerate(keys):
        for key in own:
            have.setdefault(key, set()).add(k)
    out, seen = [], set()
    for (doc_id, _), own, texts in zip(rows, keys, split, strict=True):
        kept = []
        for key, line in zip(own, texts, strict=True):
            stays = not key or len(have[key]) < least or (keep_first and key not in seen)
            seen.add(key)
            if stays:
                kept.append(line)
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


TEXTS = [
    None, "", "\n", "\n\n\n", "a\nb\na", " A \n\tb\r\n", "a", "É\né\nİ", " a\n ", "a\nkept\na\nkept too\nb", "same\nsame\nsame", "x" * 200_000 + "\na", "a\n" * 5000 + "only here",
    "\x0ba\x0c\n\x1ca", "🙂\na b\na  b", "b\n\nb",
]


def rows_of(n=3):
    return [(k, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[4])] * n + [(None, "a\nnew"), (None, "a\nnew"), (7, "same")]


def digest(rows):
    return sorted([(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in rows], key=str)


@pytest.mark.parametrize("least", [2, 4, 10])
@pytest.mark.parametrize("sliced", [False, True])
def test_by_dictionary(spark, monkeypatch, least, sliced):
    if sliced:  # nearly every key is cut into slices of documents
        monkeypatch.setattr(lines, "SHARE", 0.0)
        monkeypatch.setattr(lines, "RANGE", 8)
    rows = rows_of()
    docs = spark.createDataFrame([Row(doc_id=i, text=t, row=1, h=2, keys="own", part=3, pos=4) for i, t in rows], "doc_id long, text string, row int, h int, keys string, part int, pos int")
    docs = docs.withColumnRenamed("part", "a.b").repartition(4)
    assert digest(plain(rows, least)) == sorted([tuple(r) for r in lines.report(docs, least).collect()], key=str)


@pytest.mark.parametrize("share", [1 / 2000, 0.0])
def test_first_occurrence_stays(spark, monkeypatch, share):
    monkeypatch.setattr(lines, "SHARE", share)
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # so that rows are numbered in this order
    ours = lines.clean(docs, 2, keep_first=True).collect()
    assert sorted([(r.doc_id, r.text) for r in ours], key=str) == sorted([(d, t) for d, _, _, t in plain(rows, 2, True)], key=str)


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "b\nc\ne"), (3, "x")], "doc_id long, text string")
    runs = {r.doc_id: (r.n_lines, r.n_dropped, [tuple(x) for x in r.keep]) for r in lines.keep_bitmaps(docs, 2).collect()}
    assert runs == {1: (5, 3, [(0, 1), (3, 1)]), 2: (3, 3, []), 3: (1, 0, [(0, 1)])}


def test_a_frequent_line_is_no_large_task(spark, monkeypatch):
    monkeypatch.setattr(lines, "RANGE", 2000)
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('shared line\n', id) as text")
    rows, dropped = lines.bitmaps(docs, 10)
    assert dropped.count() == 20_000
    keyed = rows.select("row").withColumn("h", lines.F.lit(7).cast("long")).withColumn("g", lines.F.lit(1)).withColumn("pos", lines.F.lit(0))
    cuts = lines.frequent(keyed, 20_000, 10).collect()
    assert [c.slices for c in cuts] == [40]


def test_empty_table_and_no_python(spark, capsys):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.report(docs).collect() == [] and lines.clean(docs).collect() == []
    lines.report(spark.createDataFrame(rows_of(), "doc_id long, text string")).explain("formatted")
    shown = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", shown)
    # The stream is one shuffle by range; its windows add none.
    assert "hashpartitioning(part" not in shown

import gzip
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import Row

from folioflow.llm import store, warc
from folioflow.llm.queries import op9_warc

BIG = "<p>" + "word " * 40 + "</p>"
ROWS = [(5, "http://a", BIG), (3, "http://b", BIG), (9, None, BIG), (4, "http://c é", "short"), (6, "http://d\r\nX: y", "short"), (7, "u", None),
        (8, "u", ""), (3, "http://b", BIG), (None, "u", BIG), (None, "v", BIG + "x"), (None, "w", BIG + "x"), (10, "u", "é日本\r\n\r\n🙂" * 50), (11, "u", "x" * 200_000)]


def plain(rows):
    """One pass over the rows in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] or ""))
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out, seen = [], set()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        key = (html or "", page_id)
        revisit = len(raw) >= 100 and (page_id != first.get(html or "") or key in seen)
        seen.add(key)
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first.get(html or "") if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [1, 2000, 1 << 26])
def test_round_trip_and_same_files_again(spark, roll):
    docs = spark.createDataFrame([Row(page_id=i, url=u, html=h, kind=3, shard="s", digest=1) for i, u, h in ROWS]).repartition(4)
    folders = [store.fresh(spark, "test") for _ in range(2)]
    manifests = [warc.write_warc(docs.repartition(k + 2), f, roll_bytes=roll, pages_per_shard=3) for k, f in enumerate(folders)]
    assert manifests[0] == manifests[1]
    # The null page_ids of equal payload: the first by url is the response, as no numbered page has it.
    expected = [(None, len(BIG) + 1, hashlib.sha256((BIG + "x").encode()).hexdigest(), t, None) for t in ("response", "revisit")]
    found = sorted((tuple(r) for r in warc.read_warc(spark, folders[0]).collect()), key=str)
    rest = [r for r in plain(ROWS) if r[2] != expected[0][2]]
    assert found == sorted(rest + expected, key=str)
    path = Path(folders[0].removeprefix("file:"))
    names = {p.name for p in path.iterdir() if not p.name.startswith(".")}
    assert names == {"manifest.json", *(m["file"] for m in manifests[0])}
    for m in json.loads((path / "manifest.json").read_text())["files"]:
        assert hashlib.sha256((path / m["file"]).read_bytes()).hexdigest() == m["sha256"]
        assert gzip.decompress((path / m["file"]).read_bytes()).count(b"WARC/1.1\r\n") == m["records"]


def test_a_damaged_file_is_noticed(spark):
    folder = store.fresh(spark, "test")
    (m,) = warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string"), folder)
    path = Path(folder.removeprefix("file:")) / m["file"]
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(Exception, match="cut"):
        warc.read_warc(spark, folder).collect()


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op9_warc(spark, sf_dir).collect()), key=str) == plain(rows)


def test_a_shard_has_several_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_ROLL", 1)
    docs = spark.range(400).selectExpr("id as page_id", "'u' as url", "concat(id, repeat(uuid(), 40)) as html")
    made = store.keep(docs, "pages")
    _, roll = warc.sizes(made, 64 << 10)
    monkeypatch.setattr(warc, "SHARD_BYTES", 64 << 10)
    files = [m["file"] for m in warc.write_warc(made, store.fresh(spark, "test"), roll_bytes=roll, pages_per_shard=warc.sizes(made, 64 << 10)[0])]
    shards = {f.split("-")[1] for f in files}
    assert 5 < len(shards) < 20 and len(files) >= 3 * len(shards)

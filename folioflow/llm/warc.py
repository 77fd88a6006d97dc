"""Pages as WARC 1.1 archives, the same files on every run.

Pages are cut into shards in ascending page_id order. A task streams a shard into gzip files, a member for each record,
and begins a new file when one has reached the size to roll at. Headers and digests are made anew from the page. Files
are written under temporary names; tasks give them their names, and the driver publishes the manifest last.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import shard_of, shards
from .store import commit, fresh, keep, opened, prepare, read_bytes

#: Bytes of payload in a shard: of a large table more, so that it has no more than ``MOST_SHARDS``.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
#: Compressed bytes at which a file is full: this part of a shard's payload, within bounds. A shard has several files.
ROLL_PART, LEAST_ROLL, MOST_ROLL = 1 / 16, 256 << 10, 1 << 30
#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, turn: int) -> str:
    """A record's name follows from its page alone; ``turn`` tells equal rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{turn}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool, turn: int, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, turn)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest, 0))]
        head += [("X-Refers-To-Page", str(original))] if original is not None else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, read as a stream."""
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        unpacker, held = zlib.decompressobj(31), []
        raw = f.read(1 << 20)
        while raw:
            held.append(unpacker.decompress(raw))
            raw = unpacker.unused_data
            if unpacker.eof:
                text, _, rest = b"".join(held).partition(b"\r\n\r\n")
                lines = text.decode().split("\r\n")
                head = dict(line.split(": ", 1) for line in lines[1:])
                size = int(head["Content-Length"])
                if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record is damaged")
                yield head, rest[:size]
                unpacker, held = zlib.decompressobj(31), []
            raw = raw or f.read(1 << 20)
        if held:
            raise ValueError(f"{uri}: the last record is cut")


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, original) of pages whose payload others have as well: the smallest page_id with it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digests = keep(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest")).filter(F.octet_length(payload) >= LEAST_BYTES), "digests")
    several = digests.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first: a payload that many pages share is then a skewed join of two plain exchanges, which Spark splits.
    return digests.join(keep(several, "originals"), "digest").select("page_id", "digest", "original").distinct()


WRITTEN = pa.schema([("shard", pa.int64()), ("roll", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def sizes(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """Pages of a shard and bytes at which its files roll, for a table."""
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length(F.col("html").cast("string")))).first()
    shard_bytes = max(shard_bytes, (total or 0) // MOST_SHARDS)
    roll = min(MOST_ROLL, max(LEAST_ROLL, int(shard_bytes * ROLL_PART)))
    return max(1, n * shard_bytes // max(total or 0, 1)), roll


def write_warc(pages: DataFrame, folder: str, roll_bytes: int | None = None, pages_per_shard: int | None = None, date: str = DATE) -> list[dict]:
    """Write a record per page to archives in ``folder`` and return the manifest's entries.

    Of equal payloads of at least 100 bytes, the smallest page_id's is the response and the others revisit it; among rows
    of that page_id the first by url is. A null html is an empty payload, a null url leaves its header out, null page_ids
    come first, and an empty table gives a manifest without files. Other columns aren't read.
    """
    prepare(pages.sparkSession)
    by_size, roll_at = sizes(pages)
    roll_bytes = roll_bytes or roll_at
    cuts = shards(pages, "page_id", pages_per_shard or by_size, MOST_SHARDS)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("original"))
    # What was found out about a page travels to its shard as a row before it, so pages are shuffled once.
    told = originals(pages).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "original")
    rows = own.union(told).withColumn("shard", shard_of(F.col("page_id"), cuts)).repartitionById(max(1, len(cuts)), "shard")
    rows = rows.sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "kind", F.asc_nulls_first("url"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, shard, roll = _members(batches, date), None, 0
        for shard, member in stream:
            name, size, count, whole = f"_tmp-{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
            store, path = opened(folder)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                while member is not None:
                    out.write(member)
                    whole.update(member)
                    size, count = size + len(member), count + 1
                    member = None if size >= roll_bytes else next(stream, (None, None))[1]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "roll": roll, "name": name, "records": count, "bytes": size, "sha256": whole.hexdigest()}], WRITTEN)
            roll += 1

    schema = "shard long, roll long, name string, records long, bytes long, sha256 string"
    done = sorted(rows.mapInArrow(write, schema).collect(), key=lambda r: (r.shard, r.roll))
    manifest = [{"file": f"pages-{r.shard:08d}-{r.roll:04d}.warc.gz", "records": r.records, "bytes": r.bytes, "sha256": r.sha256} for r in done]
    commit(pages.sparkSession, folder, [(r.name, m["file"]) for r, m in zip(done, manifest, strict=True)], json.dumps({"files": manifest}).encode())
    return manifest


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[tuple[int, bytes]]:
    """(shard, record) of each page; rows on what is known of a page come before it."""
    page, known, turns = object(), {}, {}
    for batch in batches:
        for k in range(batch.num_rows):
            page_id = batch.column("page_id")[k].as_py()
            if page_id != page:
                page, known, turns = page_id, {}, {}
            if not batch.column("kind")[k].as_py():
                known[batch.column("digest")[k].as_py()] = batch.column("original")[k].as_py()
                continue
            payload = batch.column("html")[k].as_py().encode()
            digest = hashlib.sha256(payload).hexdigest()
            turn = turns[digest] = turns.get(digest, -1) + 1
            revisit = digest in known and (turn > 0 or known[digest] != page_id)
            yield batch.column("shard")[k].as_py(), record(page_id, batch.column("url")[k].as_py(), payload, digest, known.get(digest), revisit, turn, date)


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_warc(spark, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the files that the manifest names.

    Digests of what a file holds are computed again; a file that differs from its headers raises an error.
    """
    files = json.loads(read_bytes(f"{folder}/manifest.json"))["files"]
    rows = spark.createDataFrame([(k, f"{folder}/{m['file']}") for k, m in enumerate(files)], "k int, uri string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                held = []
                for head, block in records(uri):
                    held.append(_row(uri, head, block))
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, READ)
                        held = []
                yield pa.RecordBatch.from_pylist(held, READ)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.repartitionById(max(1, len(files)), "k").mapInArrow(read, schema)


def _row(uri: str, head: dict[str, str], block: bytes) -> dict:
    number = {k: int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page", "X-Payload-Length")}
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    ok = f"sha256:{hashlib.sha256(block).hexdigest()}" == head["WARC-Block-Digest"]
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        ok &= hashlib.sha256(payload).hexdigest() == digest and len(payload) == number["X-Payload-Length"]
    if not ok:
        raise ValueError(f"{uri}: {head['WARC-Record-ID']} differs from its headers")
    return {"page_id": number["X-Page-ID"], "payload_bytes": number["X-Payload-Length"], "payload_digest": digest, "record_type": kind, "refers_to": number["X-Refers-To-Page"]}


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder of archives in the shared folder and read them back."""
    folder = fresh(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)

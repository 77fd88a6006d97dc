"""Removing repeated byte strings of documents, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Only the first ``LENGTH``
bytes of suffixes count, and only whether they are equal, so suffixes are sorted by fingerprints rather than by letters.

1. Texts are packed into blocks of a few MB in documents order. Exact copies of a document are set aside by their digest.
2. The difference cover ``COVER`` modulo ``PERIOD`` has, for any two places, a shift below ``PERIOD`` that puts both into
   it. Sample suffixes start at places of the cover; they are sorted by their first ``SAMPLE`` bytes, bucket by bucket.
   Two suffixes with ``LENGTH`` equal bytes have, at their shift, two samples of equal rank, as PERIOD - 1 + SAMPLE =
   LENGTH. So a suffix whose samples all have a rank of their own ties with no other over that length, and is settled.
3. The suffixes left, with a tied sample among the next ``PERIOD`` places, are put into suffix buckets by their fingerprint
   and sorted one range of buckets at a time; the rest of the corpus isn't in memory or on disk meanwhile. Of equal
   suffixes all but the first in corpus order start a repeat.

A suffix entry carries a second fingerprint of 32 bits, of other numbers for the bytes and another base. Entries are equal
if both are, so two different strings would have to collide in 96 bits; among the 2 * 10**13 entries of 100 TB less than one
pair in a hundred such corpora does. One fingerprint alone decides about order and buckets only.

A block sends each bucket its distinct entries once, sorted and packed; so a string that a third of all documents
hold is one entry per block. A bucket answers with a bit for each entry.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, prepare
from .texts import byte_values, mixed, polynomial

LENGTH, PERIOD = 100, 57
# A perfect difference set modulo 57; every difference occurs.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = LENGTH - PERIOD + 1
#: Bytes of text in a block, entries of a bucket, and ranges of suffix buckets that are sorted one after another.
BLOCK_BYTES, BUCKET_ENTRIES, ROUNDS = 4 << 20, 1 << 20, 3
#: Bytes that are fingerprinted at a time, to stay in the processor's cache.
PIECE = 1 << 17
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
VALUES, SECOND_VALUES = byte_values(5), byte_values(11)
NO_ID = -(1 << 63)


# ---- one block


def at_places(data: np.ndarray, places: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """Fingerprints of the strings at ascending places, or others that are independent of them."""
    values, base = (SECOND_VALUES, SECOND_BASE) if second else (VALUES, BASE)
    out = np.empty(len(places), np.uint64)
    if len(places):
        for a in range(0, int(places[-1]) + 1, PIECE):
            i, j = np.searchsorted(places, (a, a + PIECE))
            if i < j:
                low, high = int(places[i]), int(places[j - 1])
                out[i:j] = mixed(polynomial(values[data[low : high + length]], length, base))[places[i:j] - low]
    return out


def second_at_places(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Second fingerprints of the suffixes at ascending places: the upper half, which depends on all bits."""
    return (at_places(data, places, LENGTH, second=True) >> np.uint64(32)).astype("<u4")


def cover_places(starts: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Places of the cover in each document from which a sample fits; none in documents that are skipped."""
    room = np.where(skip, 0, np.maximum(np.diff(starts) - SAMPLE + 1, 0))
    longest = int(room.max(initial=0))
    pattern = (np.arange(0, longest, PERIOD)[:, None] + np.array(COVER)).ravel()
    counts = np.searchsorted(pattern, room)
    return np.concatenate([np.zeros(0, np.int64), *(pattern[:n] + s for n, s in zip(counts.tolist(), starts[:-1].tolist(), strict=True) if n)])


def zones(tied: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of (first, after the last) place of suffixes that have a tied sample within the period."""
    n = int(starts[-1])
    change = np.zeros(n + 1, np.int32)
    own = np.searchsorted(starts, tied, side="right") - 1
    np.add.at(change, np.maximum(tied - PERIOD + 1, starts[own]), 1)
    np.add.at(change, tied + 1, -1)
    inside = np.cumsum(change[:n]) > 0
    for a, b in zip(np.maximum(starts[1:] - LENGTH + 1, starts[:-1]).tolist(), starts[1:].tolist(), strict=True):
        inside[a:b] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edge.reshape(-1, 2)


def places_of(runs: np.ndarray) -> np.ndarray:
    size = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def distinct(h: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the fingerprints, equal ones in the order given, and which of the order is the first of its value.

    With second fingerprints, only entries that agree in both are equal, and those of one first fingerprint are ordered by
    the second.
    """
    order = np.argsort(h, kind="stable")
    first = np.ones(len(h), bool)
    first[1:] = h[order[1:]] != h[order[:-1]]
    if second is not None and (~first[1:] & (second[order[1:]] != second[order[:-1]])).any():
        order = np.lexsort((second, h))
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    return order, first


def removed(data: np.ndarray, starts: np.ndarray, repeats: np.ndarray) -> list[tuple[int, int, str]]:
    """(bytes removed, runs of them, digest of what is left) of each document, from the places where repeats start."""
    change = np.zeros(len(data) + 1, np.int32)
    change[repeats] += 1
    change[repeats + LENGTH] -= 1
    gone = np.cumsum(change[:-1]) > 0
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = gone[a:b]
        n = int(np.count_nonzero(own))
        spans = int(np.count_nonzero(rise[a:b])) + int(n > 0 and bool(own[0]) and not rise[a])
        out.append((n, spans, hashlib.sha256(data[a:b][~own].tobytes() if n else data[a:b].tobytes()).hexdigest()))
    return out


# ---- packing


def packed(raw: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    raw = np.ascontiguousarray(raw)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def ascending(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"), dtype=np.uint64)


def bucket_limits(buckets: int) -> np.ndarray:
    """The first fingerprint of each bucket but the first one; buckets are equal ranges."""
    return (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)


def bucket_edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending fingerprints."""
    return np.concatenate([[0], np.searchsorted(values, bucket_limits(buckets)), [len(values)]])


def in_buckets(h: np.ndarray, buckets: int, chosen: range) -> np.ndarray:
    """Which fingerprints are of the chosen buckets."""
    limits, inside = bucket_limits(buckets), np.full(len(h), len(chosen) > 0)
    if chosen.start > 0:
        inside &= h >= limits[chosen.start - 1]
    if chosen.stop < buckets:
        inside &= h < limits[chosen.stop - 1]
    return inside


class Block:
    def __init__(self, row: dict):
        self.id = row["block"]
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))])
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.skip = np.zeros(len(self.ids), bool)
        self.skip[np.array(row.get("copies") or [], np.int64)] = True

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and ranks' fingerprints of the sample; their upper 48 bits do, as a false tie only costs a comparison."""
        places = cover_places(self.starts, self.skip)
        return places, at_places(self.data, places, SAMPLE) & np.uint64(0xFFFFFFFFFFFF0000)

    def suffixes(self, runs: bytes) -> tuple[np.ndarray, np.ndarray]:
        places = places_of(unpacked(runs, "<i8").reshape(-1, 2))
        return places, at_places(self.data, places, LENGTH)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def answers(bits: list[dict]) -> np.ndarray:
    """The bits of all buckets of a block in order."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(bits, key=lambda x: x["bucket"])]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)


# ---- the steps on Spark


def release(spark) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, so that a step's files don't add to the next one's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of documents, in order of doc_id within a block: block, ids, sizes, digests, text (all packed), bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("digests", pa.list_(pa.binary())), ("text", pa.binary()), ("bytes", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            ids = np.array([NO_ID if i is None else i for i, _ in held], "<i8").tobytes()
            nulls = np.array([i is None for i, _ in held], np.uint8).tobytes()
            sizes = np.array([len(t) for _, t in held], "<i8").tobytes()
            digests = [hashlib.sha256(t).digest() if len(t) >= LENGTH else b"" for _, t in held]
            text = zstandard.ZstdCompressor(3).compress(b"".join(t for _, t in held))
            return pa.RecordBatch.from_pylist([{"block": (part << 32) | number, "ids": ids, "nulls": nulls, "sizes": sizes, "digests": digests, "text": text, "bytes": size}], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if held and size + len(text) > block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield block()

    return keep(rows.mapInArrow(pack, "block long, ids binary, nulls binary, sizes binary, digests array<binary>, text binary, bytes long"), "blocks")


def exact_copies(blocks: DataFrame) -> DataFrame:
    """(block, copies): the documents of each block that equal an earlier one, by their place in it."""

    def list_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, own = np.frombuffer(row["ids"], "<i8"), row["digests"]
            wanted = [k for k, d in enumerate(own) if d]
            yield pa.record_batch([pa.array([row["block"]] * len(wanted), pa.int64()), pa.array(wanted, pa.int64()), pa.array(ids[wanted] if wanted else [], pa.int64()), pa.array([own[k] for k in wanted], pa.binary())], names=["block", "place", "doc_id", "digest"])

    each = keep(blocks.select("block", "ids", "digests").mapInArrow(list_documents, "block long, place long, doc_id long, digest binary"), "documents")
    first = each.groupBy("digest").agg(F.min(F.struct("doc_id", "block", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written first: a text that many documents have is then a skewed join of two plain exchanges, which Spark splits.
    later = each.join(keep(first.drop("n"), "firsts"), "digest").filter((F.col("block") != F.col("first.block")) | (F.col("place") != F.col("first.place")))
    return keep(later.groupBy("block").agg(F.collect_list("place").alias("copies")), "copies")


PACKETS = "bucket int, block long, entries binary, second binary, docs binary, ids binary"
ANSWERS = "block long, bucket int, n long, bits binary"


def packets(block: Block, values: np.ndarray, buckets: int, chosen: range, second: np.ndarray | None = None, docs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What a block sends to each bucket: its distinct fingerprints; of suffixes the second ones, too, and the document
    each is first in."""
    edges, ids = bucket_edges(values, buckets), b"" if docs is None else packed(np.diff(block.ids, prepend=0))
    for b in chosen:
        i, j = edges[b], edges[b + 1]
        if i < j:
            own = (b"", b"") if docs is None else (second[i:j].tobytes(), packed(docs[i:j].astype("<u4")))
            columns = [pa.array([b], pa.int32()), pa.array([block.id]), *(pa.array([x], pa.binary()) for x in (ascending(values[i:j]), *own, ids))]
            yield pa.record_batch(columns, names=["bucket", "block", "entries", "second", "docs", "ids"])


def sort_bucket(group: pa.Table) -> pa.Table:
    """Sort a bucket's entries. Of samples, a bit says that another block has the entry, too; of suffixes, that another
    block has it earlier."""
    group = group.sort_by("block")
    parts = [unascending(b) for b in group.column("entries").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    values, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    del parts
    suffixes = bool(group.column("ids")[0].as_py())
    order, first = distinct(values, np.concatenate([np.frombuffer(b, "<u4") for b in group.column("second").to_pylist()]) if suffixes else None)
    tied = ~np.concatenate([first[1:], [True]]) | ~first
    bits = np.zeros(len(values), bool)
    if not suffixes:
        bits[order] = tied
    else:
        ids = [np.cumsum(unpacked(b, "<i8")) for b in group.column("ids").to_pylist()]
        docs = [own[unpacked(b, "<u4")] for own, b in zip(ids, group.column("docs").to_pylist(), strict=True)]
        few, entry = order[tied], np.cumsum(first)[tied]
        again = few[rank := np.lexsort((owner[few], np.concatenate(docs)[few], entry))]
        bits[again[1:]] = entry[rank[1:]] == entry[rank[:-1]]
    cut = np.cumsum(sizes)[:-1]
    blocks, buckets = group.column("block"), group.column("bucket")
    return pa.table([blocks, buckets, pa.array(sizes), pa.array([np.packbits(x).tobytes() for x in np.split(bits, cut)], pa.binary())], names=["block", "bucket", "n", "bits"])


def answered(sent: DataFrame, name: str) -> DataFrame:
    """Each block's answers: (block, bits)."""
    bits = keep(sent.groupBy("bucket").applyInArrow(sort_bucket, ANSWERS), name)
    return bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("bits"))


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts below ``LENGTH`` bytes lose nothing. Rows of one doc_id are ordered by block and text; a
    null doc_id comes first. An empty table gives an empty one. Blocks and buckets bound what a task holds; a document
    larger than a block is a block of its own.
    """
    spark = prepare(docs.sparkSession)
    blocks = pack_blocks(docs, block_bytes)
    copies = exact_copies(blocks)
    texts = blocks.select("block", "ids", "sizes", "text").join(copies.hint("shuffle_hash"), "block", "left")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    n_samples = max(1, math.ceil(total * len(COVER) / PERIOD / bucket_entries))

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            # Sorting is far quicker here than np.unique, which hashes.
            values = np.sort(block.samples()[1])
            values = values[np.diff(values, prepend=~values[:1]) != 0]
            yield from packets(block, values, n_samples, range(n_samples))

    ranks = answered(texts.mapInArrow(send_samples, PACKETS), "ranks")
    release(spark)

    def find_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            places, h = block.samples()
            order, first = distinct(h)
            shared = answers(row["bits"] or [])[np.cumsum(first) - 1]
            local = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
            runs = zones(np.sort(places[order[shared | local[np.cumsum(first) - 1]]]), block.starts) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.record_batch([pa.array([block.id]), pa.array([packed(runs.astype("<i8").ravel())], pa.binary()), pa.array([int((runs[:, 1] - runs[:, 0]).sum())])], names=["block", "runs", "n"])

    runs = keep(texts.join(ranks.hint("shuffle_hash"), "block", "left").mapInArrow(find_zones, "block long, runs binary, n long"), "zones")
    release(spark)
    n_suffixes = max(rounds, math.ceil((runs.agg(F.sum("n")).first()[0] or 0) / bucket_entries))
    zoned = texts.join(runs.select("block", "runs").hint("shuffle_hash"), "block")
    later = None
    for r in range(rounds):
        chosen = range(r * n_suffixes // rounds, (r + 1) * n_suffixes // rounds)

        def send_suffixes(batches: Iterator[pa.RecordBatch], chosen: range = chosen) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                block = Block(row)
                places, h = block.suffixes(row["runs"])
                inside = in_buckets(h, n_suffixes, chosen)
                places, h = places[inside], h[inside]
                second = second_at_places(block.data, places)
                order, first = distinct(h, second)
                own = order[first]
                owner = np.searchsorted(block.starts, places[own], side="right") - 1
                yield from packets(block, h[own], n_suffixes, chosen, second[own], owner)

        own = keep(zoned.mapInArrow(send_suffixes, PACKETS).groupBy("bucket").applyInArrow(sort_bucket, ANSWERS), "repeats")
        later = own if later is None else later.union(own)
        release(spark)
    bits = later.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("bits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            places, h = block.suffixes(row["runs"])
            order, first = distinct(h, second_at_places(block.data, places))
            earlier = answers(row["bits"] or [])[np.cumsum(first) - 1] if len(h) else np.zeros(0, bool)
            found = removed(block.data, block.starts, np.sort(places[order[earlier | ~first]]))
            sizes, nothing = np.diff(block.starts), hashlib.sha256(b"").hexdigest()
            found = [(int(n), 1, nothing) if skip else x for x, skip, n in zip(found, block.skip.tolist(), sizes, strict=True)]
            ids = pa.array(block.ids, pa.int64(), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
            yield pa.record_batch([ids, pa.array(sizes), *(pa.array([x[k] for x in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    last = zoned.join(blocks.select("block", "nulls"), "block").join(bits.hint("shuffle_hash"), "block", "left")
    return last.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

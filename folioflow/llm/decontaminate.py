"""Benchmark decontamination: the words of documents that lie in a window of a benchmark item.

The windows of a block of items, a block holding a bounded number of bytes, are broadcast as arrays: sorted hashes, the
items of each, and where its words are in the block's text. Every task scans its texts' windows against the hashes,
verifies each hit by the bytes of its words, and marks the words it covers. A benchmark of several blocks is scanned block
by block: only the hits of a pass are written, under the number of their row. No document meets another.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep, prepare, with_text
from .texts import byte_values, flat, mixed, pieces, polynomial

WINDOW = 10
#: Bytes of benchmark text in one broadcast block, and of a part of an item's text, as a share of a block.
BLOCK_BYTES, PART = 8 << 20, 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
BASE, JOIN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
VALUES = byte_values(11)


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts; first and last byte (exclusive) of each word; words before each text, and in all."""
    data, starts = flat(column)
    data = LOWER[data]
    inside = WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = starts[(starts > 0) & (starts < len(data))]
    before[edge] = after[edge - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, first, last, np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits of each word."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    mark = np.zeros(len(data), np.int64)
    mark[first] = 1
    at = np.arange(len(data)) - first[np.cumsum(mark) - 1]
    power = np.ones(int(size.max()) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumprod(np.full(len(power) - 1, BASE, np.uint64), out=power[1:])
        value = np.where(WORD[data], VALUES[data], np.uint64(0)) * power[np.clip(at, 0, len(power) - 1)]
        return mixed(np.add.reduceat(value, first) + size.astype(np.uint64))


def windows(items: pa.Table, width: int = WINDOW) -> dict:
    """The windows of a block as arrays: ``ids`` of its items and their type, ``text`` (all words, a space after each), and by window length
    the distinct windows: hashes ascending, first byte and bytes in the text, and the items of each (where they start in
    a list of items, and that list)."""
    texts, found, passed, size = [], defaultdict(list), 0, 0
    for batch in items.to_batches():
        for part in pieces(batch, "text"):
            data, first, last, before = split_words(part.column("text"))
            long, h = last - first, word_hashes(data, first, last)
            at = np.cumsum(long + 1) - long - 1
            text = np.full(int((long + 1).sum()), 32, np.uint8)
            text[np.repeat(at, long) + np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)] = data[WORD[data]]
            counts = np.diff(before)
            owner, length = np.repeat(np.arange(len(counts)), counts), np.repeat(np.minimum(counts, width), counts)
            for n in np.unique(length).tolist():
                run = polynomial(h, n, JOIN)
                i = np.flatnonzero((length[: len(run)] == n) & (owner[: len(run)] == owner[n - 1 :]))
                found[n].append((run[i], at[i] + size, at[i + n - 1] + long[i + n - 1] - at[i], owner[i] + passed))
            texts.append(text.tobytes())
            passed, size = passed + part.num_rows, size + len(text)
    text = b"".join(texts)
    tables = {n: _distinct(text, *(np.concatenate(x) for x in zip(*own, strict=True))) for n, own in found.items()}
    return {"ids": items.column("item_id").to_pylist(), "kind": items.schema.field("item_id").type, "text": text, "tables": tables}


def _distinct(text: bytes, h: np.ndarray, at: np.ndarray, size: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((item, h))
    h, at, size, item = h[order], at[order], size[order], item[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    # Different windows of one hash are told apart by their bytes.
    kind, kinds = np.zeros(len(h), np.int64), defaultdict(dict)
    for k in np.flatnonzero(~new).tolist():
        j = int(head[k])
        own = text[at[k] : at[k] + size[k]]
        if own != text[at[j] : at[j] + size[j]]:
            kind[k] = kinds[j].setdefault(own, len(kinds[j]) + 1)
    order = np.lexsort((item, kind, h))
    h, at, size, item, kind = h[order], at[order], size[order], item[order], kind[order]
    new[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])
    once = new.copy()
    once[1:] |= item[1:] != item[:-1]
    starts = np.append(np.flatnonzero(new[once]), np.count_nonzero(once))
    return h[new], at[new].astype(np.uint32), size[new].astype(np.uint32), starts.astype(np.uint32), item[once].astype(np.uint32)


class Matcher:
    """Hits of a block's windows in texts."""

    def __init__(self, block: dict):
        self.ids, self.kind, self.text, self.tables = block["ids"], block["kind"], block["text"], block["tables"]
        self.filters = {}
        for n, (keys, *_) in self.tables.items():
            bits = max(16, int(len(keys)).bit_length() + 4)
            small = np.zeros(1 << bits, bool)
            small[keys >> np.uint64(64 - bits)] = True
            self.filters[n] = (keys, small, np.uint64(64 - bits))

    def hits(self, column: pa.Array):
        """(Place of the first word, length, window) of each verified hit; words before each text, and in all."""
        data, first, last, before = split_words(column)
        h, out = word_hashes(data, first, last), []
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        raw = None
        for n, (keys, small, shift) in self.filters.items():
            _, at, size, _, _ = self.tables[n]
            run = polynomial(h, n, JOIN) if len(h) >= n else h[:0]
            maybe = np.flatnonzero(small[run >> shift])
            maybe = maybe[owner[maybe] == owner[maybe + n - 1]]
            low, high = np.searchsorted(keys, run[maybe]), np.searchsorted(keys, run[maybe], side="right")
            some = high > low
            for i, a, b in zip(maybe[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                raw = data.tobytes() if raw is None else raw
                words = b" ".join([raw[x:y] for x, y in zip(first[i : i + n].tolist(), last[i : i + n].tolist(), strict=True)])
                out += [(i, n, k) for k in range(a, b) if int(size[k]) == len(words) and self.text.startswith(words, int(at[k]))]
        return out, before

    def items(self, found: set[tuple[int, int]]) -> set:
        """The ids of the items that have one of the windows (length, window)."""
        out = set()
        for n, k in found:
            _, _, _, starts, items = self.tables[n]
            out.update(items[starts[k] : starts[k + 1]].tolist())
        return {self.ids[i] for i in out}


def blocks(bench: DataFrame, limit: int, width: int = WINDOW) -> list[DataFrame]:
    """The benchmark in blocks of about ``limit`` bytes, by a hash of id and text. Rows that are equal count once; a text of
    more than an eighth of a block is cut into parts that overlap by ``width`` - 1 words, and so have the same windows."""
    most = max(1, limit // PART)
    rows = bench.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, first, last, _ = split_words(row.column("text"))
                n = len(first)
                if len(data) <= most or n <= width:
                    yield row
                    continue
                step = max(1, n * most // len(data))
                raw = data.tobytes()
                parts = [raw[first[a] : last[min(a + step + width - 1, n) - 1]].decode() for a in range(0, n - width + 1, step)]
                ids = row.column("item_id").take(pa.array([0] * len(parts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(parts, row.schema.field("text").type)], schema=row.schema)

    kept = keep(rows.mapInArrow(cut, rows.schema), "items")
    total = kept.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    return [kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def mark(docs: DataFrame, bench: DataFrame, carry: list[str] | None = None, width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of every document (default: all) with what the benchmark has in it:
    _n_words, _hits (runs of hit words as first word and length, merged), _items (ids of items with a window in it).

    A null text has no words and no hits; an item without words has no window; equal items are all named (those without
    an id count as one and aren't); an empty benchmark hits nothing. Rows are neither dropped nor merged. A benchmark of
    several blocks needs rows that can be told apart between the passes: the documents are written with a number once.
    """
    spark = prepare(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    runs = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("length", T.LongType())]))
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_hits", runs), T.StructField("_items", T.ArrayType(bench.schema["item_id"].dataType))]

    # A carried text that is a string is scanned where it is; others get a column that goes to the tasks only.
    text = "text" if "text" in carry and docs.schema["text"].dataType == T.StringType() else "_text"

    def scanned(frame: DataFrame, block: DataFrame, names: list[str], all_rows: bool) -> DataFrame:
        table = spark.sparkContext.broadcast(windows(block.toArrow(), width))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(table.value)
            for batch in batches:
                for part in pieces(batch, text):
                    yield _marked(part, matcher, text, names, all_rows)

        return frame.mapInArrow(scan, T.StructType([frame.schema[n] for n in names] + added))

    frame = docs.select(*carry, *([F.col("text").cast("string").alias("_text")] if text == "_text" else []))
    first, *others = blocks(bench, limit, width)
    if not others:
        return scanned(frame, first, carry, True)
    frame = keep(frame.withColumn("_row", F.monotonically_increasing_id()), "texts")
    texts = frame.select("_row", text)
    found = keep(scanned(texts, first, ["_row"], True), "hits")
    for block in others:
        found = found.union(keep(scanned(texts, block, ["_row"], False), "hits"))
    # A row has at most one entry from each block.
    each = found.groupBy("_row").agg(F.max("_n_words").alias("_n_words"), F.flatten(F.collect_list("_hits")).alias("_hits"), F.flatten(F.collect_list("_items")).alias("_items"))
    return frame.drop("_text").join(each.mapInArrow(_settled, each.schema), "_row").drop("_row")


def _spans(hits: list[tuple[int, int]]) -> list[dict]:
    """Runs (first, length) merged where they meet."""
    merged: list[list[int]] = []
    for a, n in sorted(hits):
        if merged and a <= merged[-1][0] + merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n - merged[-1][0])
        else:
            merged.append([a, n])
    return [{"first": a, "length": n} for a, n in merged]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_spans([(x["first"], x["length"]) for x in own]) for own in batch.column("_hits").to_pylist()]
        items = [sorted(set(own), key=str) for own in batch.column("_items").to_pylist()]
        put = {"_hits": hits, "_items": items}
        columns = [pa.array(put[f.name], f.type) if f.name in put else batch.column(f.name) for f in batch.schema]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _marked(part: pa.RecordBatch, matcher: Matcher, text: str, names: list[str], all_rows: bool) -> pa.RecordBatch:
    found, before = matcher.hits(part.column(text))
    by_row = defaultdict(list)
    if found:
        rows = np.searchsorted(before, [i for i, _, _ in found], side="right") - 1
        for row, hit in zip(rows.tolist(), found, strict=True):
            by_row[row].append(hit)
    hits, items = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
    for row, own in by_row.items():
        start = int(before[row])
        hits[row] = _spans([(i - start, n) for i, n, _ in own])
        items[row] = sorted(matcher.items({(n, k) for _, n, k in own}), key=str)
    spans = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
    columns = [part.column(n) for n in names] + [pa.array(np.diff(before), pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(matcher.kind))]
    out = pa.RecordBatch.from_arrays(columns, names=[*names, "_n_words", "_hits", "_items"])
    return out if all_rows else out.take(pa.array(sorted(by_row), pa.int64()))


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window in them, with the columns of ``docs``, whatever their names.

    Nulls, ties and empty tables as in ``mark``: a null text has no window and stays, equal rows stay or go together.
    """
    rows, own, restored = with_text(docs)
    return restored(mark(rows, bench, own, **options).filter(F.size("_hits") == 0))


def report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs, bench, carry=["doc_id"], **options)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    ids = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"))

"""Token ids of documents in binary files of patched frame-of-reference blocks.

Documents are cut into shards of a fixed number in ascending doc_id order; a task tokenizes a shard as a stream and
writes one file under a temporary name. The driver names the finished files and writes the manifest: with it, each file's
first place in the sequence of all ids is known. A file:

    "PFB1" | blocks of ids | blocks of document lengths | doc_ids i64 | nulls u8 | block starts u64 | footer

Footer: u64 numbers of ids, id blocks, documents, length blocks; the last 4 bytes of the file are "PFB1" again.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import struct
import sys
import threading
import types
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import shard_of, shards
from .packing import BLOCK, decode, encode
from .store import commit, fresh, opened, prepare, read_bytes, write_bytes
from .texts import pieces

MAGIC = b"PFB1"
FOOTER = "<QQQQ4s"
FOOTER_SIZE = struct.calcsize(FOOTER)
DOCS_PER_FILE = 8192
END_ID = 0
#: Blocks that are encoded or decoded at a time.
RUN = 64
#: Bytes that a task's remembered chunks may take, what one takes beside its ids, and the longest chunk remembered.
REMEMBERED, EACH, LONGEST = 96 << 20, 160, 64
#: Bytes of text that are encoded at a time.
PIECE = 1 << 20
#: Seconds after which a worker drops an encoder that no task uses.
IDLE = 15.0


#: Letters that are one piece, perhaps with a mark after them, which is one of its own.
_WORD, _MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+[.,:;!?]?"), ".,:;!?"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if it can be printed, else one from 256 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


def regular(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters, and no special token can be in it."""
    return " ".join(text.split()) == text.replace("\n", " ") and "<|" not in text


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library.

    Its pre-tokenizer never joins text across a single space or line feed between other characters (a space starts the
    next piece, a line feed is a piece), so chunks between these are encoded once and remembered by the task, up to a
    number of bytes. Texts are cut into chunks as a column: distinct chunks are looked up, and their ids are taken from
    one array. A text with other white space or what may be a special token is encoded as a whole.
    """

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        (self.line,) = self._whole("\n").tolist()
        letter = self.tokenizer.id_to_token(self._whole(" ").tolist()[0])[0]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(letter)]] = True
        self.lines = np.arange(size) == self.line
        self.marks = {m: int(self._whole(m)[0]) for m in _MARKS}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks: list[str], mark: str, starts: np.ndarray) -> None:
        """Ids of chunks, each after ``mark``: all in one text, cut where a token starts with the mark."""
        if not chunks:
            return
        ids = self._whole(mark + mark.join(chunks))
        cuts = np.flatnonzero(starts[ids])
        if len(cuts) != len(chunks) or cuts[0]:
            each = [self._whole(mark + c) for c in chunks]
            ids, cuts = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
        self._remember(chunks if mark == " " else [mark + c for c in chunks], ids, cuts)

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words after a space, perhaps with a mark behind. A word is one piece, which the model knows how to cut."""
        if not words:
            return
        bodies = [w[:-1] if w[-1] in self.marks else w for w in words]
        pieces_ = (" " + "\n ".join(bodies)).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[10])
        tokenize, ids, cuts, marks = self.tokenizer.model.tokenize, [], [], self.marks
        for word, body, piece in zip(words, bodies, pieces_, strict=True):
            cuts.append(len(ids))
            ids += [t.id for t in tokenize(piece)]
            if body is not word:
                ids.append(marks[word[-1]])
        self._remember(words, np.array(ids, np.uint32), np.array(cuts))

    def _remember(self, chunks: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        n, at = len(self.known), self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(chunks) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[at : at + len(ids)] = ids
        self.starts[n : n + len(chunks)] = at + cuts
        self.lengths[n : n + len(chunks)] = np.diff(np.append(cuts, len(ids)))
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _regular(self, texts: list[str]) -> list[np.ndarray]:
        """A line feed before each text makes its first chunk one that follows a line feed; its id is left out again."""
        if 4 * self.used + EACH * len(self.known) > REMEMBERED:
            self._forget()
        column = pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string())
        parts = pc.split_pattern(column, " ")
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int32, len(chunks))
        missing = np.flatnonzero(at < 0)
        new = [chunks[k] for k in missing.tolist()]
        for short in (True, False):  # long chunks last: they aren't remembered
            some = [c for c in new if (len(c) <= LONGEST) == short]
            if not short:
                kept, used = len(self.known), self.used
            spaced = [c for c in some if c[0] != "\n"]
            words = [c for c in spaced if _WORD.fullmatch(c)]
            self._learn_words(words)
            self._learn([c for c in spaced if c not in self.known] if words else spaced, " ", self.spaced)
            self._learn([c[1:] for c in some if c[0] == "\n" and len(c) > 1], "\n", self.lines)
            if "\n" in some:
                self._learn([""], "\n", self.lines)
        at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int32, len(new))
        at = at[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        # Every chunk's ids follow its first one.
        step = np.repeat(self.starts[at] - (ends - lengths), lengths)
        step += np.arange(len(step))
        ids = self.ids[step]
        edges = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        if len(self.known) > kept:
            self.known = {c: k for c, k in self.known.items() if k < kept}
            self.used = used
            if len(self.ids) > 4 * max(used, 1 << 16):
                self.ids = self.ids[: 2 * used + 1].copy()
        return [ids[a + 1 : b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [regular(t) for t in texts]
        known = iter(self._regular([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        return [np.asarray(next(known) if p else self._whole(t), "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]


@contextmanager
def worker_encoder(path: str) -> Iterator[Encoder]:
    """The encoder of this worker process, with what it remembers from earlier tasks.

    Functions travel by value, and their globals with them, so what stays between tasks is in a module of its own. It is
    dropped when no task has used it for ``IDLE`` seconds, since the worker goes on to other operators' tasks.
    """
    held = sys.modules.setdefault("folioflow_worker", types.ModuleType("folioflow_worker"))
    if hasattr(held, "timer"):
        held.timer.cancel()
    own = getattr(held, "own", None)
    if own is None or own[0] != path:
        own = held.own = (path, Encoder(path))
    try:
        yield own[1]
    finally:
        held.timer = threading.Timer(IDLE, _dropped, [held])
        held.timer.daemon = True
        held.timer.start()


def _dropped(held: types.ModuleType) -> None:
    held.own = None
    gc.collect()
    pa.default_memory_pool().release_unused()
    # What is freed goes back to the system where the C library can do that.
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def file_parts(docs: Iterator[tuple[int | None, bytes]], told: dict) -> Iterator[bytes]:
    """A file's bytes from (doc_id, ids as little-endian u32); ``told`` gets its numbers."""
    yield MAGIC
    at, starts, held, lengths, names = len(MAGIC), [], b"", [], []

    def put(blocks: list[bytes]) -> Iterator[bytes]:
        nonlocal at
        for block in blocks:
            starts.append(at)
            at += len(block)
            yield block

    step, n_ids, waiting = 4 * BLOCK * RUN, 0, []
    size = 0
    for doc_id, ids in docs:
        names.append(doc_id)
        lengths.append(len(ids) // 4)
        n_ids += len(ids) // 4
        waiting.append(ids)
        size += len(ids)
        if size >= step:
            held = b"".join(waiting)
            cut = size - size % step
            yield from put(encode(np.frombuffer(held, "<u4", cut // 4)))
            waiting, size = [held[cut:]], size - cut
    yield from put(encode(np.frombuffer(b"".join(waiting), "<u4")))
    id_blocks = len(starts)
    yield from put(encode(np.array(lengths, np.uint32)))
    yield np.array([0 if x is None else x for x in names], "<i8").tobytes()
    yield np.array([x is None for x in names], np.uint8).tobytes()
    yield np.array([*starts, at], "<u8").tobytes()
    yield struct.pack(FOOTER, n_ids, id_blocks, len(names), len(starts) - id_blocks, MAGIC)
    told |= {"docs": len(names), "ids": n_ids}


def read_docs(uri: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of them) of each document of a file; ids are decoded a run of blocks at a time."""
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        n_ids, id_blocks, n_docs, len_blocks, magic = struct.unpack(FOOTER, f.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't complete")
        n_starts = id_blocks + len_blocks + 1
        tail = f.read_at(8 * n_starts + 9 * n_docs, size - FOOTER_SIZE - 8 * n_starts - 9 * n_docs)
        names = np.frombuffer(tail, "<i8", n_docs).tolist()
        nulls = np.frombuffer(tail, np.uint8, n_docs, 8 * n_docs).tolist()
        starts = np.frombuffer(tail, "<u8", n_starts, 9 * n_docs).astype(np.int64).tolist()

        def numbers(a: int, b: int) -> np.ndarray:
            raw = memoryview(f.read_at(starts[b] - starts[a], starts[a]))
            return decode([raw[starts[k] - starts[a] : starts[k + 1] - starts[a]] for k in range(a, b)])

        lengths = numbers(id_blocks, id_blocks + len_blocks).tolist()
        have, used, block = np.zeros(0, np.uint32), 0, 0
        for name, null, length in zip(names, nulls, lengths, strict=True):
            crc, left = 0, length
            while left:
                if used == len(have):
                    have, used, block = numbers(block, min(block + RUN, id_blocks)), 0, min(block + RUN, id_blocks)
                part = have[used : used + left]
                crc, used, left = zlib.crc32(part.astype("<u4").tobytes(), crc), used + len(part), left - len(part)
            yield (None if null else name), length, crc


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE) -> list[dict]:
    """Write the ids of every document, ``end_id`` after each, to files in ``folder`` and return the manifest's entries.

    A null text has the end id alone. Null doc_ids come first; rows of one doc_id follow each other, ordered by their
    text. An empty table gives a manifest without files. Other columns aren't read.
    """
    prepare(docs.sparkSession)
    cuts = shards(docs, "doc_id", docs_per_file)
    n = max(1, len(cuts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), cuts)).repartitionById(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, shard = np.array([end_id], "<u4").tobytes(), [None]

        def stream(encoder: Encoder) -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                shard[0] = batch.column("shard")[0].as_py()
                for part in pieces(batch, "text", PIECE):
                    ids = encoder.encode(part.column("text").to_pylist())
                    for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                        yield doc_id, own + end

        told, name = {}, f"_tmp-{uuid.uuid4().hex}"
        with worker_encoder(tokenizer) as encoder:
            docs_ = stream(encoder)
            first = next(docs_, None)
            if first is None:
                return
            size = write_bytes(f"{folder}/{name}", file_parts(chain([first], docs_), told))
        yield pa.RecordBatch.from_pylist([{"shard": shard[0], "name": name, "size": size, **told}], WRITTEN)

    done = sorted(rows.mapInArrow(write, "shard long, name string, size long, docs long, ids long").collect(), key=lambda r: r.shard)
    manifest, start = [], 0
    for r in done:
        manifest.append({"file": f"ids-{r.shard:08d}.pfb", "start": start, "docs": r.docs, "ids": r.ids, "bytes": r.size})
        start += r.ids
    names = [(r.name, m["file"]) for r, m in zip(done, manifest, strict=True)]
    commit(docs.sparkSession, folder, names, json.dumps({"tokenizer": os.path.basename(tokenizer), "end_id": end_id, "files": manifest}).encode())
    return manifest


WRITTEN = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    files = json.loads(read_bytes(f"{folder}/manifest.json"))["files"]
    rows = spark.createDataFrame([(k, f"{folder}/{m['file']}", m["start"]) for k, m in enumerate(files)], "k int, uri string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                held = []
                for doc_id, n, crc in read_docs(uri):
                    held.append({"doc_id": doc_id, "start": start, "n_tokens": n, "ids_crc32": crc})
                    start += n
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, READ)
                        held = []
                yield pa.RecordBatch.from_pylist(held, READ)

    return rows.repartitionById(max(1, len(files)), "k").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the documents' ids to a new folder of files in the shared folder and read them back."""
    folder = fresh(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, folder, **options)
    return read_tokens(docs.sparkSession, folder)

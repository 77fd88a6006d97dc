"""Texts of an Arrow batch as one array of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each starts (one more entry: the end); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, a row at least; no row is cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit, prepend=0) > 0)
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def polynomial(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbours, modulo 2**64, by doubling."""
    total, done, power = None, 0, np.uint64(base)
    part, size = values.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if total is None:
                    total, done = part, size
                else:
                    n = max(len(values) - done - size + 1, 0)
                    total, done = total[:n] * power + part[done : done + n], done + size
            if 2 * size > length:
                return total
            n = max(len(values) - 2 * size + 1, 0)
            part, size = part[:n] * power + part[size : size + n], 2 * size
            power = power * power


def mixed(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """256 fixed pseudo-random numbers, one for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

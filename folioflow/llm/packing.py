"""Patched frame of reference: blocks of 1,024 numbers below 2**32.

A block keeps its minimum, the differences to it at the width that a percentile of them needs, and the differences above
that width as exceptions (place and high bits). Layout of a block, little-endian:

    minimum u32 | width u8 | numbers - 1 u16 | exceptions u16 | width * 16 words u64 | places u16 | high bits u32

The packed words hold 16 lanes of 64 numbers; number ``i`` of a block is place ``i // 16`` of lane ``i % 16``.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
LANES, DEEP = 16, 64
HEAD = "<IBHH"
HEAD_SIZE = struct.calcsize(HEAD)
#: Share of a block's differences that must fit the packed width.
PERCENTILE = 0.9


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1,024 numbers below 2**width as rows of 16 * width words."""
    v = values.astype(np.uint64).reshape(-1, DEEP, LANES)
    out = np.zeros((len(v), width, LANES), np.uint64)
    for i in range(DEEP):
        word, off = divmod(i * width, 64)
        if width:
            out[:, word] |= v[:, i] << np.uint64(off)
            if off + width > 64:
                out[:, word + 1] |= v[:, i] >> np.uint64(64 - off)
    return out.reshape(len(v), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), DEEP, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(DEEP if width else 0):
        word, off = divmod(i * width, 64)
        v = w[:, word] >> np.uint64(off)
        if off + width > 64:
            v = v | (w[:, word + 1] << np.uint64(64 - off))
        out[:, i] = v & mask
    return out.reshape(len(words), BLOCK)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of some numbers; only the last may be short."""
    n = len(values)
    if not n:
        return []
    rows = -(-n // BLOCK)
    full = np.full(rows * BLOCK, values[-1], np.uint32)
    full[:n] = values
    full = full.reshape(rows, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    fits = np.sort(rest, axis=1)[:, min(BLOCK - 1, int(percentile * BLOCK))]
    widths = np.array([int(x).bit_length() for x in fits.tolist()])
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        part = rest[own]
        packed = pack(part & np.uint32((1 << width) - 1), width)
        for k, row in enumerate(own.tolist()):
            over = np.flatnonzero(part[k] >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
            count = min(BLOCK, n - row * BLOCK)
            over = over[over < count]
            high = part[k][over] >> np.uint32(width) if width < 32 else over
            head = struct.pack(HEAD, int(low[row]), width, count - 1, len(over))
            out[row] = head + packed[k].tobytes() + over.astype("<u2").tobytes() + high.astype("<u4").tobytes()
    return out


def decode(blocks: list[bytes | memoryview]) -> np.ndarray:
    """The numbers of some blocks in a row."""
    heads = [struct.unpack_from(HEAD, b) for b in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    by_width: dict[int, list[int]] = {}
    for k, (_, width, _, _) in enumerate(heads):
        by_width.setdefault(width, []).append(k)
    for width, own in by_width.items():
        words = np.stack([np.frombuffer(blocks[k], "<u8", width * LANES, HEAD_SIZE) for k in own])
        rest = unpack(words, width)
        for row, k in enumerate(own):
            low, _, last, over = heads[k]
            v, at = rest[row], HEAD_SIZE + 8 * width * LANES
            if over:
                places = np.frombuffer(blocks[k], "<u2", over, at)
                v[places] |= np.frombuffer(blocks[k], "<u4", over, at + 2 * over).astype(np.uint64) << np.uint64(width)
            out[k] = (v[: last + 1] + np.uint64(low)).astype(np.uint32)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)

"""Vectorised views of text columns: words, their hashes and normalised bytes, a block of documents at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D. Null texts have no words. Everything works on whole texts;
blocks only bound the memory of the NumPy arrays (a text longer than a block is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 256), _STEP | np.uint64(1))], dtype=np.uint64)
    return _POWERS[:n]


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows with at most ``limit`` bytes, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@dataclass
class Words:
    """Words of a block. start, end: byte ranges; row: the row in the block; first: of each row, and the total at the end."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True) -> Words:
    rows = len(offsets) - 1
    gap = _SEPARATOR[data]
    opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
    opens[1:] = gap[:-1]
    closes[:-1] = gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = True
    closes[inner - 1] = True
    start = np.flatnonzero(opens & ~gap)
    end = np.flatnonzero(closes & ~gap) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int64)
    h = np.zeros(len(start), np.uint64)
    if hashes and len(start):
        span = np.diff(np.r_[start, len(data)])
        place = np.arange(start[0], len(data)) - np.repeat(start, span)
        part = (_LOWER[data] if lower else data)[start[0] :]
        value = _BYTE[part] * powers(int(place.max()) + 1)[place]
        value[gap[start[0] :]] = 0
        h = mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))
    return Words(start, end, row, first, h)


def spaced(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The block's words each followed by one space, and the byte where each word starts there (and the total length)."""
    size = w.end - w.start + 1
    at = np.r_[0, np.cumsum(size)].astype(np.int64)
    out = np.full(at[-1], 32, np.uint8)
    if len(size):
        body = np.arange(at[-1]) - np.repeat(at[:-1], size)
        inside = body < np.repeat(size - 1, size)
        out[inside] = data[(body + np.repeat(w.start, size))[inside]]
    return out, at


def shingle_hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words of one row; a row with fewer words has one, of all its words."""
    h, rows = w.hash, len(w.first) - 1
    n = np.diff(w.first)
    starts = np.flatnonzero(np.arange(len(h)) + width <= np.repeat(w.first[1:], n))
    value = np.zeros(len(starts), np.uint64)
    for k in range(width):
        value = mix(value + h[starts + k] + np.uint64(k))
    row = w.row[starts]
    for r in np.flatnonzero((n > 0) & (n < width)):
        whole = np.uint64(n[r])
        for x in h[w.first[r] : w.first[r + 1]]:
            whole = mix(np.array([whole]) * np.uint64(3) + x)[0]
        value, row = np.append(value, whole), np.append(row, r)
    assert rows >= 0
    return value, row

"""Vectorised word, line and shingle kernels over Arrow string buffers.

Texts are handled as one UTF-8 byte array per chunk of whole rows, so that a
word, a line or a word prefix is a byte range and its 64-bit hash comes from a
prefix sum of ``T[byte] * p**position`` (mod 2**64).  Work is cut into chunks
of about a megabyte of whole rows, which bounds memory whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer words and lines are hashed by themselves; the polynomial is for short ranges.
LONG_RANGE = 255

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA3B195354A39B70D)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Chunk:
    """Whole rows ``first .. first+n-1`` of a batch as bytes with row offsets."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Yield row chunks of about ``limit`` bytes; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield Chunk(start, stop - start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``S`` with ``S[e] - S[s]`` the raw polynomial of bytes ``s .. e-1``."""
    power, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
    return sums


def range_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes anywhere."""
    _, inverse = _power(len(data) + 1)
    h = mix64((sums[end] - sums[start]) * inverse[start])
    for i in np.flatnonzero(end - start > LONG_RANGE):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member`` that don't cross rows."""
    n = len(member)
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = member[:-1]
        after[:-1] = member[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def row_of(offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, start, "right") - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def words(chunk: Chunk, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, with hashes."""
    data = LOWER[chunk.data] if lower else chunk.data
    start, end = runs(~IS_SPACE[data], chunk.offsets)
    row = row_of(chunk.offsets, start)
    return Words(start, end, row, range_hash(data, prefix_sums(data), start, end), np.bincount(row, minlength=chunk.n))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every ``k``-word window within a row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    mixed = np.zeros(len(at), np.uint64)
    for j in range(k):
        mixed += w.hash[at + j] * COEF[j]
    return mix64(mixed), at


def shingle_sets(w: Words, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles: hashes ordered by row, and row offsets.

    A row with 1 to ``k-1`` words has its whole sequence as the only shingle;
    a row without words has none.
    """
    h, at = grams(w, k)
    rows = w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        first = np.cumsum(w.count) - w.count
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.count[short] > j
            extra[has] += w.hash[first[short[has]] + j] * COEF[32 + j]
        extra = mix64(extra + w.count[short].astype(np.uint64))
        h, rows = np.concatenate([h, extra]), np.concatenate([rows, short])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[keep], rows[keep]
    offsets = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=offsets[1:])
    return h, offsets

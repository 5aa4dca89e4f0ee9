"""Vectorised text primitives shared by the Arrow-batch operators.

Everything here works on one Arrow string column at a time: the UTF-8 bytes of
all rows are viewed as one numpy array, so word splitting and hashing cost a
few nanoseconds a byte and no Python loop over words.  A column is processed in
slices of about ``CHUNK_BYTES`` so that memory stays bounded however many rows
an Arrow batch holds; a single longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; their arrays take up to ninety times as much.
CHUNK_BYTES = 256 << 10

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-free table of byte codes, the same in every process.
_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second table, for hashes of 128 bits.
_CODE2 = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes together."""
    limit = limit or CHUNK_BYTES
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and each text's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's end is a word's end
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes the hash of any byte range from them.

    ``second`` takes other byte codes, so that both hashes together have 128 bits.
    """
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODE if lower else _CODE2 if second else _CODE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of byte ranges, equal for equal bytes wherever they lie."""
    _, down = _power_tables(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of each run of ``n`` neighbouring values (one fewer than n missing)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        total = total * _BASE + values[k : len(values) - n + 1 + k]
    return mix(total)

"""Vectorised text kernels shared by the corpus operators.

A *token* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text.  All functions work on whole Arrow string
columns: token boundaries and 64-bit token hashes come from a handful of numpy
passes over the UTF-8 bytes, without a Python object for any token.
"""

from __future__ import annotations

import sys

import numpy as np
import zstandard
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for 0 <= j < n."""
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; gives the high and low bits alike full entropy."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """0, then the running sums of values[j] * BASE**j."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the rows from 0, bytes) of an Arrow string or binary column; a null is an empty row."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def chunks(column, size: int = CHUNK_BYTES):
    """(first row, row after the last, byte offsets, bytes) of runs of whole rows of about ``size`` bytes."""
    offsets, raw = string_parts(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]
        lo = hi


def spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends of all tokens, running hash sums of the bytes)."""
    word = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1, prefix(raw.astype(U64) + U64(1))


def tokens(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the tokens of row i are hashes[bounds[i]:bounds[i + 1]]."""
    if not len(raw):
        return np.zeros(len(offsets), np.int64), np.zeros(0, U64)
    starts, stops, sums = spans(offsets, raw)
    return np.searchsorted(starts, offsets), mix((sums[stops] - sums[starts]) * powers(len(raw))[1][starts])


def tokens_and_prefixes(offsets: np.ndarray, raw: np.ndarray, sizes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens(), and (rows, hashes) of the first ``sizes`` bytes of every longer token."""
    if not len(raw):
        none = np.zeros(0, U64)
        return np.zeros(len(offsets), np.int64), none, np.zeros(0, np.int64), none
    starts, stops, sums = spans(offsets, raw)
    bounds, down = np.searchsorted(starts, offsets), powers(len(raw))[1]
    rows, of, found = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), [], []
    for size in sizes:
        at = np.flatnonzero(stops - starts > size)
        of.append(rows[at])
        found.append(mix((sums[starts[at] + size] - sums[starts[at]]) * down[starts[at]] + U64(size << 40)))
    return bounds, mix((sums[stops] - sums[starts]) * down[starts]), np.concatenate(of), np.concatenate(found)


def grams(bounds: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of n tokens that lie within one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums, count = prefix(hashes), len(hashes) - n + 1
    whole = np.ones(count, bool)
    inner = bounds[1:-1]
    for k in range(1, n):
        at = inner - k
        whole[at[(at >= 0) & (at < count)]] = False
    at = np.flatnonzero(whole)
    return at, mix((sums[at + n] - sums[at]) * powers(len(hashes))[1][at] + U64(n))


def row_of(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


def row_sets(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values) of each row's sorted distinct values; rows ascend."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[keep], values[keep]
    return np.searchsorted(rows, np.arange(n + 1)), values


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    values = np.ascontiguousarray(values, np.uint64)
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.view(np.uint8).reshape(-1, 8)[:, :used].T
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def place_cuts(grams: np.ndarray, places: int, bits: int) -> np.ndarray:
    """Where the ranges of the places begin in sorted fingerprints."""
    edges = np.array([(p << bits) // places for p in range(places)], np.uint64)
    return np.r_[np.searchsorted(grams, edges), len(grams)]


def release() -> None:
    """Give freed memory back: a worker that serves many groups would keep the most that any of them took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

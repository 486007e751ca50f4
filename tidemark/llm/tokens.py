"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes, a bounded slice of the batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes; one longer text is a slice of its own.
SLICE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C55)
_U = np.uint64

SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Digits, lower-case letters and everything outside ASCII, for text whose capitals were lowered.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    out = x >> _U(30)
    out ^= x
    out *= _U(0xBF58476D1CE4E5B9)
    for by, factor in ((_U(27), _U(0x94D049BB133111EB)), (_U(31), None)):
        out ^= out >> by
        if factor is not None:
            out *= factor
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n, kept for the usual slice size."""
    if n > 1 << 19:  # one very long text: its table is not kept
        up, down = _powers.__wrapped__(n)
    else:
        up, down = _powers(1 << 19)
    return up[:n], down[:n]


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one by one; what the work on one has freed goes back to the system before the next and at the end.

    Python workers outlive their tasks, so memory they keep is missing to the stages that follow.
    """
    for batch in batches:
        yield batch
        del batch
        give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] equal to the sum of (byte + 1) * _BASE**position over i <= position < j."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, equal for equal bytes wherever they stand."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACE_SEPARATED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the row it stands in; words end where texts end."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    keep = np.zeros(n + 2, bool)
    keep[1:-1] = inside[data]
    turn = np.flatnonzero(keep[1:] != keep[:-1])  # words begin and end by turns
    cut = np.unique(offsets[1:-1])
    cut = cut[keep[cut] & keep[cut + 1]]  # inside a word, as one text ends and the next begins
    if len(cut):
        turn = np.insert(turn, np.repeat(np.searchsorted(turn, cut), 2), np.repeat(cut, 2))
    start, end = turn[::2].copy(), turn[1::2].copy()
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words; the words of a text with fewer make one shingle."""
    if not len(hashes):
        return hashes, row
    k = max(0, len(hashes) - n + 1)
    acc = hashes[:k].copy()
    for j in range(1, n):
        acc = mix(acc) + hashes[j : k + j]
    whole = row[:k] == row[n - 1 :] if k else np.zeros(0, bool)
    got, at = mix(acc[whole]), row[:k][whole]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[begin, len(row)])
    for b, c in zip(begin[count < n], count[count < n], strict=True):
        one = hashes[b : b + 1] + _U(c)
        for j in range(1, c):
            one = mix(one) + hashes[b + j : b + j + 1]
        got, at = np.r_[got, mix(one + _U(0x51))], np.r_[at, row[b]]
    order = np.lexsort((got, at))
    return got[order], at[order]


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, hash) without repeats."""
    if not len(hashes):
        return hashes, row
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]
    return hashes[keep], row[keep]

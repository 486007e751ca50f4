"""Keys packed by key range, so that millions of them are shuffled as few rows and grouped in numpy.

A batch of (key, owner) becomes one row per block with the keys of that block as bytes; blocks are dealt out by Spark and
hold as many keys as a caller plans for, whatever the size of the whole. A key that very many owners have is no more than
its entries in one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .tokens import frugal, mix

LOW = np.uint64((1 << 48) - 1)
_U = np.uint64
PACKED = "block int, low binary, high binary, owner binary, size binary, many binary"


def _cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as binary cells."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def pack_rows(block: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per block: the values of its rows, column by column, as bytes."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[cut, len(block)]
    return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int32)), *[_cells(c[order], ends) for c in columns.values()]], names=["block", *columns])


def by_block(batches) -> Iterator[list[list[bytes]]]:
    """The cells of each block, column by column, from rows of pack_rows of which each block's stand together."""
    now, parts = None, []
    for batch in frugal(batches):
        cells = [batch.column(i) for i in range(1, batch.num_columns)]
        for row, block in enumerate(batch.column(0).to_pylist()):
            if block != now and parts:
                yield list(zip(*parts, strict=True))
                parts = []
            now = block
            parts.append([c[row].as_py() for c in cells])
    if parts:
        yield list(zip(*parts, strict=True))


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(key) >> _U(33)) % _U(blocks)


def pack(keys: list[np.ndarray], owners: np.ndarray, sizes: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Rows of PACKED: the keys of each owner, of which 48 bits count, and the owner's size."""
    key = np.concatenate(keys) & LOW
    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    block = block_of(key, blocks).astype(np.int32)
    order = np.argsort(block, kind="stable")
    key, of, block = key[order], of[order], block[order]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    run = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (of[1:] != of[:-1])])
    many = np.diff(np.r_[run, len(key)])
    ends, run_ends = np.r_[cut, len(key)], np.r_[np.searchsorted(run, cut), len(run)]
    return pa.RecordBatch.from_arrays([
        pa.array(block[cut]), _cells(key.astype(np.uint32), ends), _cells((key >> _U(32)).astype(np.uint16), ends),
        _cells(owners[of[run]], run_ends), _cells(sizes[of[run]].astype(np.int32), run_ends), _cells(many.astype(np.int32), run_ends),
    ], names=["block", "low", "high", "owner", "size", "many"])


def packed(rows: Iterable[tuple[list[np.ndarray], np.ndarray, np.ndarray]], blocks: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """rows of (keys of each owner, owners, sizes), packed about `chunk` keys at a time; an owner told twice counts once."""
    keys: list[np.ndarray] = []
    owners, sizes, count = [], [], 0

    def flush():
        owner, first = np.unique(np.concatenate(owners), return_index=True)
        return pack([keys[i] for i in first], owner, np.concatenate(sizes)[first], blocks)

    for more, owner, size in rows:
        keys += more
        owners.append(owner)
        sizes.append(size)
        count += sum(map(len, more))
        if count >= chunk:
            yield flush()
            keys, owners, sizes, count = [], [], [], 0
    if count:
        yield flush()


def shared_keys(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of PACKED rows, each block's together: key, owner, size of owners that share a key with one of a like size.

    Sizes are alike if den times the less is num times the greater or more; of a key's owners by size, one that is not
    like the next smaller nor the next greater is like none.
    """

    def found(columns):
        cat = lambda i, kind: np.frombuffer(b"".join(columns[i]), kind)
        key = cat(1, np.uint16).astype(np.uint64) << _U(32) | cat(0, np.uint32)
        many = cat(4, np.int32)
        owner, size = np.repeat(cat(2, np.uint64), many), np.repeat(cat(3, np.int32), many)
        order = np.lexsort((owner, key))
        key, owner, size = key[order], owner[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner, size = key[new], owner[new], size[new]
        order = np.lexsort((size, key))
        key, owner, size = key[order], owner[order], size[order].astype(np.int64)
        same = np.r_[False, (key[1:] == key[:-1]) & (den * size[:-1] >= num * size[1:])]
        same[:-1] |= same[1:]
        size = size.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key[same].view(np.int64)), pa.array(owner[same].view(np.int64)), pa.array(size[same])], names=["key", "owner", "size"])

    for columns in by_block(batches):
        yield found(columns)

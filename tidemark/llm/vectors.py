"""Vectors as whole numbers, in blocks of rows that numpy works on, and exact sums of them by task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

#: Vectors in a block.
BLOCK = 2048
#: Whole numbers are held within this bound on both sides, so that squared distances stay exact in 64 bits.
MOST = 1 << 24
#: A key with more than this part of all rows is joined apart from the others.
HEAVY_PART = 1000


def finite(vector: str) -> Column:
    """Whether a vector is there and has no null or non-finite component; an empty one has none."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), held within MOST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of rows with `width` numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, two or four to a number; wide() reads them again."""
    small = not values.size or np.abs(values).max() < 1 << 15
    return (b"\x02" if small else b"\x04") + values.astype("<i2" if small else "<i4").tobytes()


def wide(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, f"<i{cell[0]}", offset=1).astype(np.int64).reshape(-1, width)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries; through floating-point products where these are exact."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * most * most * max(1, points.shape[1]) < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)


def total(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of a table of whole numbers, which `add` puts each batch into.

    A task gives the lines of its table that are not zero, Spark adds them up by line, and the driver gets as many
    lines as the table has, which does not depend on the rows.
    """

    def task(batches):
        table = np.zeros(shape, np.int64)
        for b in batches:
            add(table, b)
        line = np.flatnonzero(table.any(1))
        if len(line):
            yield pa.RecordBatch.from_arrays([pa.array(line.astype(np.int32)), *map(pa.array, np.ascontiguousarray(table[line].T))], names=["line", *names])

    names = [f"s{i}" for i in range(shape[1])]
    lines = rows.mapInArrow(task, "line int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros(shape, np.int64)
    for r in lines.groupBy("line").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r[0]] = r[1:]
    return out


def join_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows, already written, with the sum of `value` over the rows of equal key; null is a key.

    The sums are broadcast if there are at most BROADCAST_ROWS of them. If there are more, those of the few keys with
    over a thousandth of all rows are, and the other rows are shuffled by a key that none of them shares with many.
    """
    sums = rows.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("_n")).withColumnRenamed(key, "_key")
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_n")
    bound = rows.count() // HEAVY_PART
    heavy = F.broadcast(sums.where(F.col("_n") > bound).drop("_n"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    rest = rows.join(heavy, same, "left_anti").join(sums.where(F.col("_n") <= bound).drop("_n"), same)
    return rows.join(heavy, same).unionByName(rest).drop("_key")

"""Clusters of vectors around centroids: Lloyd's rounds spared by Hamerly's bounds, in whole numbers.

Every vector keeps, from round to round, its centroid, an upper bound of its distance to it and one lower bound of its
distance to all others. When centroids move, the upper bound grows by its centroid's way and the lower one shrinks by
the longest way of another. Where the upper bound stays under the lower one, or under half the way from its centroid to
the next, the vector stays where it is without a look at it; otherwise its distance is taken exactly, and if that does
not settle it, it is compared with all centroids in whole numbers. Bounds are rounded outwards and compared strictly, so
a tie is always compared exactly.

Blocks of vectors are written anew each round with their bounds, which is also what a lost executor starts again from.
Only what moved is added up: a task gives at most one line of differences for each centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release
from .tokens import frugal
from .vectors import BLOCK, blocks, finite, matrix, narrow, squared, total, whole, wide

_STATE = ["vec_ids", "vectors", "near", "upper", "lower", "moved", "scanned"]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point to its own line of centroids."""
    return ((points - centroids) ** 2).sum(1)


@dataclass(frozen=True)
class Moves:
    """What a round must know of the centroids: where they are, how far each came at most, half the way to the next at least."""

    centroids: np.ndarray
    way: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, before: np.ndarray, after: np.ndarray) -> Moves:
        gaps = squared(after, after).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        half = _down(np.sqrt(gaps.min(axis=1, initial=np.inf)) / 2)
        return cls(after, _up(np.sqrt(exact(after, before).astype(np.float64))) * (before != after).any(1), half)

    def longest_other(self) -> np.ndarray:
        """For each centroid the longest way of another."""
        order = np.argsort(self.way)
        out = np.full(len(self.way), self.way[order[-1]])
        out[order[-1]] = self.way[order[-2]] if len(order) > 1 else 0.0
        return out


def settle(points: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties to the smaller), bounds, and how many points were compared with all centroids.

    Points without a centroid yet have near 0 and no bounds: upper infinite, lower 0.
    """
    near, upper = near.copy(), _up(upper + moves.way[near])
    lower = _down(lower - moves.longest_other()[near])
    open_ = np.flatnonzero(upper >= np.maximum(lower, moves.half[near]))
    if len(open_):
        upper[open_] = _up(np.sqrt(exact(points[open_], moves.centroids[near[open_]]).astype(np.float64)))
        open_ = open_[upper[open_] >= np.maximum(lower[open_], moves.half[near[open_]])]
    if len(open_):
        far = squared(points[open_], moves.centroids)
        near[open_] = np.argmin(far, axis=1)  # the first of equal ones
        upper[open_] = _up(np.sqrt(far[np.arange(len(open_)), near[open_]].astype(np.float64)))
        far[np.arange(len(open_)), near[open_]] = np.iinfo(np.int64).max
        lower[open_] = _down(np.sqrt(far.min(axis=1).astype(np.float64)))
    return near, upper, lower, len(open_)


def moved_sums(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray:
    """Differences of each centroid's sums and count, as (centroid, component and count)."""
    out = np.zeros((k, points.shape[1] + 1), np.int64)
    changed = np.arange(len(points)) if before is None else np.flatnonzero(before != after)
    ones = np.c_[points[changed], np.ones(len(changed), np.int64)]
    np.add.at(out, after[changed], ones)
    if before is not None:
        np.subtract.at(out, before[changed], ones)
    return out


@dataclass(frozen=True)
class Clusters:
    """Rows (vec_id, cluster, distance: squared), written; the centroids; vectors compared with all centroids by round."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, seed: str = "2", block: int = BLOCK) -> Clusters:
    """Clusters of the column `embedding` of (vec_id, embedding).

    Rows without exactly `width` components, none of them null or non-finite, are left out. Components are
    floor(scale * x), held within 2**24. The first centroids are the vectors with the smallest SHA-256 of seed:vec_id
    (a null vec_id last; equal ones by vector; repeated rows count as often as they stand there), in ascending order;
    there may be fewer than `clusters`. A centroid without vectors stays. After the rounds all are assigned once more.
    No rows give no clusters. Other columns are not looked at.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.where(finite("embedding") & (F.size("embedding") == width)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # a bare hash: Spark hashes every vec_id and takes the few smallest
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(clusters).select("embedding").collect()
    if not first:
        return Clusters(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), np.zeros((0, width), np.int64), [])
    centroids = whole(np.array([r[0] for r in first], np.float64), scale)
    k = len(centroids)
    schema = f"vec_ids array<{kind}>, vectors binary, near binary, upper binary, lower binary, moved binary, scanned int"

    def state(ids: pa.Array, points: np.ndarray, before: np.ndarray | None, found: tuple) -> pa.RecordBatch:
        near, upper, lower, scanned = found
        cells = [narrow(points), near.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), moved_sums(points, before, near, k).tobytes()]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *[pa.array([c], pa.binary()) for c in cells], pa.array([scanned], pa.int32())], names=_STATE)

    def begun(batches: Iterator[pa.RecordBatch], moves: Moves) -> Iterator[pa.RecordBatch]:
        for b in blocks(frugal(batches), block):
            points = whole(matrix(b.column(1), width), scale)
            none = np.zeros(len(points))
            yield state(b.column(0), points, None, settle(points, none.astype(np.int64), none + np.inf, none, moves))

    def again(batches: Iterator[pa.RecordBatch], moves: Moves) -> Iterator[tuple]:
        """ids, points, former centroids and what settle() finds, block by block."""
        for b in frugal(batches):
            for row in range(b.num_rows):
                points = wide(b.column(1)[row].as_py(), width)
                near = np.frombuffer(b.column(2)[row].as_py(), "<i4").astype(np.int64)
                upper, lower = (np.frombuffer(b.column(i)[row].as_py(), np.float64) for i in (3, 4))
                yield b.column(0)[row].values, points, near, settle(points, near, upper, lower, moves)

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for cell in batch.column(0):
            sums += np.frombuffer(cell.as_py(), np.int64).reshape(sums.shape)

    sums, scanned, moves, table = 0, [], Moves.between(centroids, centroids), None
    for _ in range(rounds):
        last = table
        if last is None:
            table = durable(kept.mapInArrow(lambda b, m=moves: begun(b, m), schema), "bounds")
        else:
            table = durable(last.mapInArrow(lambda b, m=moves: (state(*x) for x in again(b, m)), schema), "bounds")
            release(last)
        sums = sums + total(table.select("moved"), add, (k, width + 1))
        scanned.append(table.agg(F.sum("scanned")).first()[0] or 0)
        after = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), centroids)  # numpy's // floors
        centroids, moves = after, Moves.between(centroids, after)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, _, (near, _, _, _) in again(batches, moves):
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(exact(points, centroids[near]))], names=["vec_id", "cluster", "distance"])

    if table is None:  # no rounds at all
        table = durable(kept.mapInArrow(lambda b: begun(b, moves), schema), "bounds")
    out = durable(table.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "clusters")
    release(table)
    return Clusters(out, centroids, scanned)

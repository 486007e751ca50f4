"""Product quantisation of vectors: codebooks by Lloyd's rounds with the filtering algorithm, in whole numbers throughout.

Vectors are cut into parts. Each block of vectors has a kd-tree per part, built once and written: boxes, sums and counts
of every node. A round sends the codebook down each tree: of a node's entries those go that no point of its box can be
nearest to, and a node left with one entry gives it its sums and count as they are cached, without a look at its points.
What remains at a leaf is compared point by point. Only sums by entry leave a task, so a round moves as much as the
codebooks hold, whatever the number of vectors.
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

#: Points of a leaf, about.
LEAF = 16
#: Numbers in one step of the walk down a tree.
STEP = 1 << 20


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return np.arange((1 << level) + 1) * n >> level


def depth(n: int, leaf: int = LEAF) -> int:
    return max(0, int(n // leaf).bit_length() - 1)


@dataclass
class Tree:
    """Points in the order of the leaves, the rows they are of, and of each node, level by level, its box and sums."""

    points: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Nodes are halved at the median of their widest side, all nodes of a level at once."""
        n, rows, low, high = len(points), np.arange(len(points)), [], []
        for level in range(depth(n, leaf) + 1):
            at = bounds(n, level)
            low.append(np.minimum.reduceat(points, at[:-1]))
            high.append(np.maximum.reduceat(points, at[:-1]))
            if level < depth(n, leaf):
                node = np.repeat(np.arange(1 << level), np.diff(at))
                side = np.argmax(high[-1] - low[-1], axis=1) if points.shape[1] else np.zeros(1 << level, int)
                key = points[np.arange(n), side[node]] if points.shape[1] else node
                order = np.lexsort((key, node))
                points, rows = points[order], rows[order]
        sums = [np.add.reduceat(points, bounds(n, level)[:-1]) for level in range(depth(n, leaf) + 1)]
        return cls(points, rows, np.concatenate(low), np.concatenate(high), np.concatenate(sums))

    def cells(self) -> list[bytes]:
        return [narrow(self.points), self.rows.astype("<i4").tobytes(), narrow(self.low), narrow(self.high), self.sums.astype("<i8").tobytes()]

    @classmethod
    def of(cls, cells: list[bytes], width: int) -> Tree:
        points, rows, low, high, sums = cells
        return cls(wide(points, width), np.frombuffer(rows, "<i4"), wide(low, width), wide(high, width), np.frombuffer(sums, "<i8").reshape(-1, width))


def filtered(tree: Tree, entries: np.ndarray, sums: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, int]:
    """(the nearest entry of each point of a tree, ties to the lower; how many points were assigned with their node).

    With `sums`, a line of components and a count for each entry, the points' sums are added to it.
    """
    n, k, width = len(tree.points), len(entries), max(1, entries.shape[1])
    nearest, whole_nodes = np.zeros(n, np.int64), 0
    # nodes still open on a level, and the entries still open for each, node by node, in ascending order
    walk = [(0, np.zeros(1, np.int64), np.array([k]), np.arange(k))]
    levels = int(len(tree.low) + 1).bit_length() - 1
    while walk:
        level, node, many, entry = walk.pop()
        if len(node) > 1 and len(entry) * width > step:
            half = len(node) // 2
            cut = many[:half].sum()
            walk += [(level, node[half:], many[half:], entry[cut:]), (level, node[:half], many[:half], entry[:cut])]
            continue
        at, first = (1 << level) - 1 + node, np.r_[0, np.cumsum(many)[:-1]]
        of = np.repeat(np.arange(len(node)), many)
        low, high = tree.low[at], tree.high[at]
        e = entries[entry]
        # the entry nearest to the middle of the box, both doubled
        middle = (((low + high)[of] - 2 * e) ** 2).sum(1)
        hit = np.flatnonzero(middle == np.minimum.reduceat(middle, first)[of])
        best = entry[hit[np.searchsorted(of[hit], np.arange(len(node)))]]
        b = entries[best][of]
        # at the corner farthest towards an entry, it is nearer than the best or it is so nowhere in the box
        corner = np.where(e > b, high[of], low[of])
        gain = ((corner - e) ** 2).sum(1) - ((corner - b) ** 2).sum(1)
        keep = (gain < 0) | (gain == 0) & (entry <= best[of])
        of, entry = of[keep], entry[keep]
        many = np.bincount(of, minlength=len(node))
        alone = many == 1
        edge = bounds(n, level)
        for i in np.flatnonzero(alone):
            nearest[edge[node[i]] : edge[node[i] + 1]] = best[i]
        counts = edge[node[alone] + 1] - edge[node[alone]]
        whole_nodes += int(counts.sum())
        if sums is not None:
            np.add.at(sums[:, :-1], best[alone], tree.sums[at[alone]])
            np.add.at(sums[:, -1], best[alone], counts)
        open_, still = ~alone, ~alone[of]
        of, entry = of[still], entry[still]
        node, many = node[open_], many[open_]
        if not len(node):
            continue
        if level + 1 < levels:
            ends = np.cumsum(many)
            # both halves of a node get its entries
            taken = np.concatenate([np.arange(e - m, e) for e, m in zip(np.repeat(ends, 2), np.repeat(many, 2), strict=True)])
            walk.append((level + 1, np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(many, 2), entry[taken]))
            continue
        at = np.r_[0, np.cumsum(many)]
        for i, x in enumerate(node):
            left, points = entry[at[i] : at[i + 1]], tree.points[edge[x] : edge[x + 1]]
            got = left[np.argmin(squared(points, entries[left]), axis=1)]
            nearest[edge[x] : edge[x + 1]] = got
            if sums is not None:
                np.add.at(sums[:, :-1], got, points)
                np.add.at(sums[:, -1], got, 1)
    return nearest, whole_nodes


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(part, vector, component): equal consecutive parts, the last filled up with zeros."""
    width = -(-vectors.shape[1] // parts)
    filled = np.zeros((len(vectors), parts * width), np.int64)
    filled[:, : vectors.shape[1]] = vectors
    return filled.reshape(len(vectors), parts, width).transpose(1, 0, 2)


@dataclass(frozen=True)
class Coded:
    """Rows (vec_id, label, code: one byte per part, error: squared distances summed over parts), written; and the
    codebooks, one array of (entry, component) per part."""

    rows: DataFrame
    codebooks: list[np.ndarray]


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, block: int = BLOCK) -> Coded:
    """Codes of the column `embedding` of (vec_id, label, embedding).

    Rows whose vector is null or holds a null or non-finite component are left out, and so are vectors without the
    length that most have (the greater of two lengths as frequent), which no codebook fits. Components are
    floor(scale * x), held within 2**24. A length that the parts do not divide is filled up with zeros. The codebooks
    begin as the parts of the vectors with the smallest vec_ids (nulls last, then by vector; repeated rows count as
    often as they stand there), of which there may be fewer than `entries`. Ties go to the lower entry. No rows give no
    codes and empty codebooks. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    spark = vectors.sparkSession
    kept = vectors.where(finite("embedding")).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    types = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}"
    if lengths is None:
        return Coded(spark.createDataFrame([], f"{types}, code binary, error long"), [np.zeros((0, 0), np.int64)] * parts)
    d, width = lengths["d"], -(-lengths["d"] // parts)
    kept = kept.where(F.size("embedding") == d)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(frugal(batches), block):
            trees = [Tree.build(p).cells() for p in _parts(whole(matrix(b.column(2), d), scale), parts)]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, *[pa.array([list(c)], pa.list_(pa.binary())) for c in zip(*trees, strict=True)]], names=names)

    names = ["vec_ids", "labels", "points", "rows", "low", "high", "sums"]
    table = durable(kept.mapInArrow(built, ", ".join(f"{n} array<{vectors.schema[c].dataType.simpleString()}>" for n, c in (("vec_ids", "vec_id"), ("labels", "label"))) + "".join(f", {n} array<binary>" for n in names[2:])), "trees")

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    books = list(_parts(whole(np.array([r[0] for r in first], np.float64).reshape(-1, d), scale), parts))

    def trees_of(batch: pa.RecordBatch, row: int, start: int) -> list[Tree]:
        cells = [batch.column(i)[row].as_py() for i in range(start, start + 5)]
        return [Tree.of([c[p] for c in cells], width) for p in range(parts)]

    for _ in range(rounds):
        k = len(books[0])

        def add(sums: np.ndarray, batch: pa.RecordBatch, books=books, k=k) -> None:
            for row in range(batch.num_rows):
                for p, tree in enumerate(trees_of(batch, row, 0)):
                    filtered(tree, books[p], sums[p * k : (p + 1) * k])

        sums = total(table.select(*names[2:]), add, (parts * k, width + 1)).reshape(parts, k, width + 1)
        count = sums[:, :, -1:]
        # numpy's // floors, as it must for negative sums
        books = [np.where(c > 0, s // np.maximum(c, 1), b) for s, c, b in zip(sums[:, :, :-1], count, books, strict=True)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frugal(batches):
            for row in range(b.num_rows):
                ids, labels = b.column(0)[row].values, b.column(1)[row].values
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(trees_of(b, row, 2)):
                    near, _ = filtered(tree, books[p])
                    code[tree.rows, p] = near
                    error[tree.rows] += ((tree.points - books[p][near]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    out = durable(table.mapInArrow(coded, f"{types}, code binary, error long"), "codes")
    release(table)
    return Coded(out, books)


def decoded(coded: Coded, scale: float = 1024.0) -> DataFrame:
    """vec_id and the vector that its code stands for: the middles of the steps that its entries were rounded down from."""
    books = coded.codebooks

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, len(books))
            values = np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((values + 0.5) / scale), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    kind = coded.rows.schema["vec_id"].dataType.simpleString()
    return coded.rows.select("vec_id", "code").mapInArrow(look_up, f"vec_id {kind}, embedding array<double>")

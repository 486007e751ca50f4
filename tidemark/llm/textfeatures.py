"""Hashed words and structure statistics of texts, as sparse rows in numpy; whole texts, a slice at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ALPHANUMERIC, SPACE_SEPARATED, frugal, lowered, prefix_hash, span_hash, text_slices, words

STATISTICS = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "beyond_ascii", "distinct", "repeated", "line_words", "bar", "long_word")
N_STATISTICS = len(STATISTICS)
_U = np.uint64


@dataclass
class Sparse:
    """Rows of (bucket, value): row r holds the entries begin[r] to begin[r + 1]."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def sparse_rows(column: pa.Array, buckets: int, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, Sparse]]:
    """(first row, features of consecutive rows): counts of hashed words, and of the first so many bytes of longer words
    if prefixes names any lengths; and the structure statistics."""
    for at, data, offsets in text_slices(column):
        n = len(offsets) - 1
        low = lowered(data)
        start, end, row = words(low, offsets, ALPHANUMERIC)
        sums = prefix_hash(low)
        h, row = [span_hash(sums, start, end)], [row]
        for size in prefixes:
            longer = end - start > size
            h.append(span_hash(sums, start[longer], start[longer] + size) + _U(size))
            row.append(row[0][longer])
        h, row = np.concatenate(h), np.concatenate(row)
        cell = row.astype(np.int64) * buckets + (h >> _U(20)).astype(np.int64) % buckets
        cell, count = np.unique(cell, return_counts=True)
        begin = np.searchsorted(cell // buckets, np.arange(n + 1))
        # statistics go by words between white space
        s, e, r = words(data, offsets, SPACE_SEPARATED)
        many = np.bincount(r, minlength=n).astype(float)
        wh = span_hash(prefix_hash(data), s, e)
        same = np.r_[False, (wh[1:] == wh[:-1]) & (r[1:] == r[:-1])] if len(r) else np.zeros(0, bool)
        order = np.lexsort((wh, r))
        fresh = np.r_[True, (wh[order][1:] != wh[order][:-1]) | (r[order][1:] != r[order][:-1])] if len(r) else np.zeros(0, bool)
        size, some = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(many, 1)
        isin = lambda chars: np.isin(data, np.frombuffer(chars, np.uint8))
        stats = np.stack([
            np.log1p(many), np.bincount(r, e - s, n) / some, _per_row((data >= 65) & (data <= 90), offsets) / size, _per_row((data >= 48) & (data <= 57), offsets) / size,
            _per_row(isin(b"#*$%&|<>{}[]\\^~=+_@"), offsets) / size, _per_row(isin(b".,;:'\"?!()-"), offsets) / size, _per_row(data >= 128, offsets) / size,
            np.bincount(r[order][fresh], minlength=n) / some, np.bincount(r[same], minlength=n) / some, np.log1p(many / (1 + _per_row(data == 10, offsets))),
            _per_row(data == 124, offsets) / some, np.bincount(r[(e - s) > 24], minlength=n) / some,
        ], 1)
        yield at, Sparse(begin, (cell % buckets).astype(np.int32), count.astype(np.float32), stats)


ROW = "doc_id long, label double, index array<int>, value array<float>, stats array<double>"


def _rows(batches, buckets: int, prefixes: tuple[int, ...]):
    for batch in frugal(batches):
        for at, x in sparse_rows(batch.column(1), buckets, prefixes):
            n = len(x.begin) - 1
            ends = pa.array(x.begin, pa.int32())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * N_STATISTICS, pa.int32()), pa.array(x.stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.ListArray.from_arrays(ends, pa.array(x.index)), pa.ListArray.from_arrays(ends, pa.array(x.value)), stats], names=["doc_id", "label", "index", "value", "stats"])


def held_out(doc_id, folds: int = 5):
    """True where crc32 of the id as text is divisible by folds; those rows' labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, buckets: int, prefixes: tuple[int, ...] = ()):
    """Features of at most `most` labelled documents outside the held-out fold, the first by a hash of the id.

    labels has doc_id and label; of several labels of a doc_id the greatest counts, of several texts the one whose hash
    is least. Only this bounded sample comes to the driver. Returns (doc_ids, labels, Sparse).
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.max("label").alias("label"))
    got = texts.select("doc_id", "text", "label").mapInArrow(lambda b: _rows(b, buckets, prefixes), ROW).toPandas().sort_values("doc_id")
    begin = np.cumsum([0, *map(len, got["index"])])
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in got[c]]) if len(got) else np.zeros(0, kind)
    stats = flat("stats", float).reshape(-1, N_STATISTICS)
    return got["doc_id"].to_numpy(), got["label"].to_numpy(float), Sparse(begin, flat("index", np.int32), flat("value", np.float32), stats)


def row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row; rows without entries sum to nothing."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]

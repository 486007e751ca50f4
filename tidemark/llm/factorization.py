"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length of the text.

The pairwise part is computed in linear time: half of (sum of v x) squared less the sum of (v x) squared, for each
factor. The model is fitted on a bounded sample of labelled documents and is a few hundred kilobytes whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textfeatures import N_STATISTICS, Sparse, held_out, row_sums, sparse_rows, training_rows
from .tokens import frugal

#: Labelled rows the model is fitted on, at most.
TRAINING_ROWS = 6000
BUCKETS = 1 << 13
FACTORS = 8
#: Feature layout: word buckets, one bucket per power of two of the words in the text, standardised statistics.
LENGTHS = 24
WIDTH = BUCKETS + LENGTHS + N_STATISTICS
STEPS, BATCH, RATE, DECAY = 1500, 128, 0.08, 1e-4
THRESHOLD = 0.3


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, feature and value of each entry: unit-length word counts, the length bucket, the statistics."""
        n = len(x.begin) - 1
        norm = np.sqrt(np.maximum(row_sums(x.value.astype(float) ** 2, x.begin), 1))
        row = np.repeat(np.arange(n), np.diff(x.begin))
        size = np.minimum(np.floor(x.stats[:, 0] / np.log(2)).astype(int), LENGTHS - 1)
        stats = np.clip((x.stats - self.mean) / self.scale, -4, 4)
        rows = np.concatenate([row, np.arange(n), np.repeat(np.arange(n), N_STATISTICS)])
        feature = np.concatenate([x.index, BUCKETS + size, np.tile(BUCKETS + LENGTHS + np.arange(N_STATISTICS), n)])
        value = np.concatenate([x.value / norm[row], np.full(n, 0.5), stats.ravel() / 2])
        order = np.argsort(rows, kind="stable")
        return np.searchsorted(rows[order], np.arange(n + 1)), feature[order], value[order]

    def logits(self, begin: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[feature] * value[:, None]
        s = row_sums(vx, begin)
        pairs = 0.5 * (s**2 - row_sums(vx**2, begin)).sum(1)
        return self.bias + row_sums(self.linear[feature] * value, begin) + pairs, s

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.design(x))[0], -30, 30)))


def fit(y: np.ndarray, x: Sparse, seed: int = 7) -> Machine:
    """Minibatch AdaGrad on the log loss. Without both labels the machine gives their share (0.5 without any)."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.stats.mean(0), np.maximum(x.stats.std(0), 1e-3)) if len(y) else (np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)), mean, scale)
    if len(np.unique(y)) < 2:
        m.factors[:] = 0
        return m
    begin, feature, value = m.design(x)
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2), 1e-2
    for _ in range(max(1, STEPS * BATCH // len(y))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            part = np.cumsum([0, *(begin[rows + 1] - begin[rows])])
            f, v = feature[take], value[take]
            z, s = m.logits(part, f, v)
            g = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows), np.diff(part))
            gw = np.bincount(f, g * v, WIDTH)
            gv = np.zeros((WIDTH, FACTORS))
            each = np.repeat(s, np.diff(part), 0)
            for k in range(FACTORS):
                gv[:, k] = np.bincount(f, g * (v * each[:, k] - m.factors[f, k] * v**2), WIDTH)
            gw, gv, gb = gw + DECAY * m.linear * (gw != 0), gv + DECAY * m.factors * (gv != 0), g[part[:-1]].sum()
            seen_w, seen_v, seen_b = seen_w + gw**2, seen_v + gv**2, seen_b + gb**2
            m.linear -= RATE * gw / np.sqrt(seen_w)
            m.factors -= RATE * gv / np.sqrt(seen_v)
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Machine:
    """labels (doc_id, quality): fitted on at most `most` of them, none with crc32(doc_id) divisible by 5."""
    _, y, x = training_rows(docs, labels.select("doc_id", F.col("quality").alias("label")), most, BUCKETS)
    return fit(y, x)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted, one row per row.

    Only the text enters the score. A null text scores as an empty one; repeated rows score alike; a null doc_id is not
    held out. Texts of any length are scored whole, in slices of an Arrow batch; other columns, whatever their names, are
    left out; a score of just THRESHOLD counts as good. An empty table gives no rows.
    """

    def run(batches):
        for batch in frugal(batches):
            for at, x in sparse_rows(batch.column(1), BUCKETS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x.stats)), pa.array(machine.score(x))], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs whose text scores THRESHOLD or more, with all their columns, whatever their names.

    Null and empty texts, repeated rows and very long texts are judged as score() does.
    """
    columns, types = docs.columns, docs.schema

    def run(batches):
        for batch in frugal(batches):
            text = batch.column(columns.index("text"))
            for at, x in sparse_rows(text, BUCKETS):
                part = batch.slice(at, len(x.stats))
                yield part.filter(pa.array(machine.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, types)

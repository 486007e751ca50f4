"""Toxicity by classifier chains over hashed words.

Categories are predicted one after the other; each later linear model also gets the logits of the earlier categories.
The models are trained with out-of-fold predictions of the earlier ones, so they see there what they will see when
scoring: the predictions of a model that has not learned the row. Words are weighted by their naive-Bayes log ratio.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textfeatures import Sparse, held_out, row_sums, sparse_rows, training_rows
from .tokens import frugal

#: Labelled rows the chain is fitted on, at most.
TRAINING_ROWS = 4000
BUCKETS = 1 << 18
#: Besides whole words, their first so many bytes are features.
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
#: Pseudo-counts of the log ratios, strength of the quadratic penalty, steps and momentum of the descent.
SMOOTHING, PENALTY, STEPS, MOMENTUM = 0.5, 1e-5, 120, 0.9
#: Features of fewer training rows weigh nothing.
LEAST_ROWS = 3
THRESHOLD = 0.2


@dataclass
class Link:
    """One linear model of the chain: weights of the words' presence and of the earlier categories' logits."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, x: Sparse, earlier: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + row_sums(self.words[x.index], x.begin) + earlier @ self.earlier, -30, 30)


@dataclass
class Chain:
    categories: list[str]
    links: list[Link] = field(default_factory=list)

    def logits(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x.begin) - 1, 0))
        for link in self.links:
            out = np.c_[out, link.logits(x, out)]
        return out


def _rows(x: Sparse, keep: np.ndarray) -> Sparse:
    rows = np.flatnonzero(keep)
    take = np.concatenate([np.arange(x.begin[r], x.begin[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
    return Sparse(np.cumsum([0, *(x.begin[rows + 1] - x.begin[rows])]), x.index[take], x.value[take], x.stats[rows])


def _fit(y: np.ndarray, x: Sparse, earlier: np.ndarray) -> Link:
    n = len(y)
    share = np.clip(y.mean(), 0.001, 0.999) if n else 0.5
    link = Link(np.zeros(BUCKETS), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return link
    used = np.flatnonzero(np.bincount(x.index, minlength=BUCKETS) >= LEAST_ROWS)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[x.index] >= 0
    begin, index = np.r_[0, np.cumsum(keep)][x.begin], place[x.index[keep]]
    row = np.repeat(np.arange(n), np.diff(begin))
    up, down = np.bincount(index, y[row], len(used)) + SMOOTHING, np.bincount(index, 1 - y[row], len(used)) + SMOOTHING
    ratio = np.log((up / (y.sum() + 2 * SMOOTHING)) / (down / ((1 - y).sum() + 2 * SMOOTHING)))
    value = ratio[index]
    # plain descent with momentum: what tells the labels apart has large ratios and is learned first
    rate = 4 / max(1.0, float((value**2).sum()) / n)
    w, a, b = np.zeros(len(used)), link.earlier.copy(), link.bias
    vw, va, vb = np.zeros_like(w), np.zeros_like(a), 0.0
    for _ in range(STEPS):
        z = b + np.bincount(row, w[index] * value, n) + earlier @ a
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        vw = MOMENTUM * vw - rate * (np.bincount(index, g[row] * value, len(used)) + PENALTY * w)
        va, vb = MOMENTUM * va - rate * (earlier.T @ g), MOMENTUM * vb - rate * g.sum()
        w, a, b = w + vw, a + va, b + vb
    words = np.zeros(BUCKETS)
    words[used] = w * ratio
    return Link(words, a, float(b))


def fit(labels: np.ndarray, x: Sparse, categories: list[str]) -> Chain:
    """labels: one column per category, NaN where unknown."""
    chain, n = Chain(categories), len(labels)
    fold = np.arange(n) % FOLDS
    before = np.zeros((n, 0))
    for k in range(len(categories)):
        y, known = labels[:, k], ~np.isnan(labels[:, k])
        chain.links.append(_fit(y[known], _rows(x, known), before[known]))
        if k + 1 < len(categories):
            out = np.zeros(n)
            for f in range(FOLDS):
                learn, rest = known & (fold != f), fold == f
                out[rest] = _fit(y[learn], _rows(x, learn), before[learn]).logits(_rows(x, rest), before[rest])
            before = np.c_[before, out]
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = TRAINING_ROWS) -> Chain:
    """labels (doc_id, one 0/1 column per category), of which at most `most` rows, outside the held-out fold, are read."""
    packed = labels.where(F.coalesce(*categories).isNotNull()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    code = F.lit(0)
    for c in categories:  # base three: no, yes, unknown
        code = code * 3 + F.coalesce(F.col(c).cast("int"), F.lit(2))
    _, codes, x = training_rows(docs, packed.select("doc_id", code.alias("label")), most, BUCKETS, PREFIXES)
    table = np.stack([(codes.astype(int) // 3 ** (len(categories) - 1 - k)) % 3 for k in range(len(categories))], 1).astype(float) if len(codes) else np.zeros((0, len(categories)))
    table[table == 2] = np.nan
    return fit(table, x, categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out and, for each category c, p_c and c (1 if p_c is THRESHOLD or more).

    One row per row of docs. Null and empty texts have no words and get the base rates; repeated rows score alike; words
    nobody labelled weigh nothing. Rows without doc_id are scored and not held out. Texts of any length are scored whole,
    in slices of an Arrow batch; other columns, whatever their names, are left out; a probability of just THRESHOLD counts
    as the category. An empty table gives no rows.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in frugal(batches):
            for at, x in sparse_rows(batch.column(1), BUCKETS, PREFIXES):
                p = 1 / (1 + np.exp(-chain.logits(x)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(p)), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])]], names=["doc_id", *names])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, *[(F.col(f"p_{c}") >= THRESHOLD).cast("int").alias(c) for c in chain.categories])

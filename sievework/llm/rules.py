"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Trees are grown on the driver from a bounded sample of labelled rows, on histograms of each feature. A constrained
feature may only be split so that the leaf values go the right way, and both subtrees keep to their side of the middle of
the two values, so the score is monotonic in it. The fitted trees are flat numpy arrays of nodes, and all rows of a slice
go down a tree together, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ints, read, slices
from .docstats import NAMES, statistics
from .toxicity import sample_of

MAX_LABELLED = 20_000  # bound of the sample of labelled rows used for fitting
#: -1: more of it never raises the score, 1: never lowers it.
MONOTONE = {"symbol": -1, "bang": -1, "pipe": -1, "same_line": -1, "word_repeats": -1, "top_word": -1, "distinct_words": 1}
TREES, DEPTH, RATE, BINS, LEAF, L2 = 120, 4, 0.1, 64, 20, 1.0


@dataclass
class Trees:
    """Node k of a tree at node[t, k]: its children are 2k+1 and 2k+2. feature is -1 in a leaf."""

    base: float
    feature: np.ndarray  # int32 (trees, nodes)
    cut: np.ndarray  # go left if x <= cut
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                g = f[at]
                inner = g >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(g, 0)] > c[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Logistic loss, second-order leaf values. A single class or no rows give a constant."""
    size = 2 ** (DEPTH + 1) - 1
    rate_y = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(rate_y / (1 - rate_y))), np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size)))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return Trees(model.base, model.feature[:0], model.cut[:0], model.value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin <= k is x <= edges[k]
    score = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        open_nodes = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            k, rows, lo, hi, depth = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(-g / (h + L2), lo, hi))
            best = None
            if depth < DEPTH and len(rows) >= 2 * LEAF:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weight, len(e) + 1))[:-1] for weight in (grad[rows], hess[rows], None))
                    vl, vr = np.clip(-gl / (hl + L2), lo, hi), np.clip(-(g - gl) / (h - hl + L2), lo, hi)
                    gain = -(gl * vl + 0.5 * (hl + L2) * vl**2) - ((g - gl) * vr + 0.5 * (h - hl + L2) * vr**2) + (g * value + 0.5 * (h + L2) * value**2)
                    gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -np.inf
                    if monotone[f]:
                        gain[(vr - vl) * monotone[f] < 0] = -np.inf
                    j = int(gain.argmax())
                    if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                        best = (gain[j], f, j, vl[j], vr[j])
            if best is None:
                model.value[t, k] = rate * value
                score[rows] += rate * value
                continue
            _, f, j, vl, vr = best
            model.feature[t, k], model.cut[t, k] = f, edges[f][j]
            left = binned[rows, f] <= j
            middle = (vl + vr) / 2
            bounds = [(lo, hi), (lo, hi)]
            if monotone[f] > 0:
                bounds = [(lo, middle), (middle, hi)]
            elif monotone[f] < 0:
                bounds = [(middle, hi), (lo, middle)]
            open_nodes += [(2 * k + 1, rows[left], *bounds[0], depth + 1), (2 * k + 2, rows[~left], *bounds[1], depth + 1)]
    return model


def _stats(batches):
    for b in slices(batches, "text"):
        x, _, _ = statistics(col(b, "text"))
        lo = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(ints(b, "quality")), pa.ListArray.from_arrays(pa.array(lo), pa.array(x.ravel()))], ["quality", "x"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Trees:
    rows = sample_of(spark, docs, labels, "quality", limit).mapInArrow(_stats, "quality long, x array<double>").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    y = (rows["quality"].to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # whatever the order of the rows, the same sums
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(n, 0) for n in NAMES]))


def scorer(spark: SparkSession, trees: Trees):
    shared = spark.sparkContext.broadcast(trees)

    def score(text: pa.Array) -> pa.Array:
        parts = [shared.value.score(statistics(b.column(0))[0]) for b in slices([pa.record_batch([text], ["text"])], "text")]
        return pa.array(1 / (1 + np.exp(-np.concatenate(parts))) if parts else np.zeros(0))

    return F.arrow_udf(score, "double")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, p_quality, kept) for every row of docs, repeated rows and null doc_ids too; kept is p_quality >= cut.

    Null and empty texts have statistics of 0. Without labels of both classes, or of fewer than 2 * LEAF documents, all rows get the
    same p_quality. Very long texts are read to their end. Other columns are not read; an empty table gives an empty result."""
    return docs.select("doc_id", scorer(spark, fit(spark, docs, labels))(docs["text"]).alias("p_quality")).withColumn("kept", F.col("p_quality") >= cut)


def op2_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

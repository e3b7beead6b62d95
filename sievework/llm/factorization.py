"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
and the pair sum is computed in linear time as 1/2 sum_k [(sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2].
Words have x = tf / |tf|, statistics are standardised and clipped, language and source are one-hot hashed.
Fitted on the driver by AdaGrad from a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, col, ints, mix, read, slices
from .docstats import NAMES, statistics
from .toxicity import sample_of

MAX_LABELLED = 5_000  # bound of the sample of labelled rows used for fitting
WORD_BITS, META, RANK = 16, 1024, 8
STAT0 = 1 << WORD_BITS
META0 = STAT0 + len(NAMES)
WIDTH = META0 + META
CLIP = 4.0


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def score(self, x: Rows) -> np.ndarray:
        return self.bias + x.sum(self.w[x.key] * x.value) + pairs(self.v, x)


@dataclass
class Rows:
    """Sparse rows: row lo[i]:lo[i+1] has the features key with value."""

    lo: np.ndarray
    key: np.ndarray
    value: np.ndarray

    def sum(self, z: np.ndarray) -> np.ndarray:
        """Every row has a feature, so reduceat is safe."""
        return np.add.reduceat(z, self.lo[:-1]) if len(self.lo) > 1 else np.zeros((0, *z.shape[1:]))


def pairs(v: np.ndarray, x: Rows) -> np.ndarray:
    z = v[x.key] * x.value[:, None]
    return 0.5 * (x.sum(z) ** 2 - x.sum(z * z)).sum(1)


def _meta_slots(column: pa.Array, kind: int) -> np.ndarray:
    names, at = np.unique(np.array(["" if s is None else s for s in column.to_pylist()], dtype=object).astype(str), return_inverse=True)
    h = []
    for s in names:
        k = 14695981039346656037 ^ kind
        for c in s.encode():
            k = ((k ^ c) * 1099511628211) & ((1 << 64) - 1)
        h.append(int(mix(np.array([k], np.uint64))[0] % U64(META)))
    return META0 + np.array(h, np.int64)[at] if len(names) else np.zeros(0, np.int64)


def raw_rows(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[Rows, np.ndarray]:
    """The features, with the statistics still in their own units, and these statistics."""
    x, _, w = statistics(text)
    n, doc = len(x), w.doc()
    both, tf = np.unique(doc * STAT0 + (w.hash >> U64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    d, key = both // STAT0, both % STAT0
    norm = np.sqrt(np.bincount(d, tf.astype(float) ** 2, n))
    each = np.arange(n)
    docs = np.concatenate([d, np.repeat(each, len(NAMES)), each, each])
    keys = np.concatenate([key, np.tile(STAT0 + np.arange(len(NAMES)), n), _meta_slots(lang, 1), _meta_slots(source, 2)])
    value = np.concatenate([tf / norm[d], x.ravel(), np.ones(2 * n)])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    return Rows(np.searchsorted(docs, np.arange(n + 1)), keys[order], value[order]), x


def standardise(x: Rows, mean: np.ndarray, sd: np.ndarray) -> Rows:
    value, at = x.value.copy(), np.flatnonzero((x.key >= STAT0) & (x.key < META0))
    k = x.key[at] - STAT0
    value[at] = np.clip((value[at] - mean[k]) / sd[k], -CLIP, CLIP) / CLIP
    return Rows(x.lo, x.key, value)


def fit_machine(x: Rows, y: np.ndarray, mean: np.ndarray, sd: np.ndarray, passes: int = 20, batch: int = 128, rate: float = 0.1, l2: float = 1e-4, seed: int = 1) -> Machine:
    """A single class gives a constant score."""
    rng = np.random.default_rng(seed)
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(np.log(p0 / (1 - p0))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK)), mean, sd)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3), 1e-3
    for _ in range(passes):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            size = x.lo[rows + 1] - x.lo[rows]
            pick = np.repeat(x.lo[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            b = Rows(np.concatenate([[0], np.cumsum(size)]), x.key[pick], x.value[pick])
            z = m.v[b.key] * b.value[:, None]
            total = b.sum(z)
            s = m.bias + b.sum(m.w[b.key] * b.value) + 0.5 * (total**2 - b.sum(z * z)).sum(1)
            e = (1 / (1 + np.exp(-s)) - y[rows]) / len(rows)
            own = np.repeat(e, size) * b.value
            used, at = np.unique(b.key, return_inverse=True)
            dw = np.bincount(at, own, len(used)) + l2 * m.w[used]
            dv = np.zeros((len(used), RANK))
            part = own[:, None] * (np.repeat(total, size, axis=0) - z)
            for k in range(RANK):
                dv[:, k] = np.bincount(at, part[:, k], len(used))
            dv += l2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += e.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * e.sum() / np.sqrt(gb)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def _sample(batches):
    for b in slices(batches, "text"):
        x, _ = raw_rows(col(b, "text"), col(b, "lang"), col(b, "source"))
        lo = pa.array(x.lo.astype(np.int32))
        yield pa.RecordBatch.from_arrays([col(b, "_id"), pa.array(ints(b, "quality")), pa.ListArray.from_arrays(lo, pa.array(x.key, pa.int32())), pa.ListArray.from_arrays(lo, pa.array(x.value, pa.float32()))], ["_id", "quality", "k", "v"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Machine:
    rows = sample_of(spark, docs, labels, "quality", limit, "lang", "source").mapInArrow(_sample, "_id long, quality long, k array<int>, v array<float>").toArrow().sort_by("_id").combine_chunks()
    lo = np.concatenate([[0], np.cumsum(rows["k"].combine_chunks().value_lengths().to_numpy())]).astype(np.int64) if rows.num_rows else np.zeros(1, np.int64)
    key, value = (rows[c].combine_chunks().flatten().to_numpy() for c in ("k", "v"))
    x = Rows(lo, key.astype(np.int64), value.astype(float))
    stats = x.value[(x.key >= STAT0) & (x.key < META0)].reshape(-1, len(NAMES)) if rows.num_rows else np.zeros((1, len(NAMES)))
    mean, sd = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    return fit_machine(standardise(x, mean, sd), (rows["quality"].to_numpy() > 0).astype(float), mean, sd)


def scorer(spark: SparkSession, machine: Machine):
    shared = spark.sparkContext.broadcast(machine)

    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        m, parts = shared.value, []
        for b in slices([pa.record_batch([text, lang, source], ["text", "lang", "source"])], "text", 1 << 19):
            x, _ = raw_rows(b.column(0), b.column(1), b.column(2))
            parts.append(m.score(standardise(x, m.mean, m.sd)))
        return pa.array(1 / (1 + np.exp(-np.concatenate(parts))) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(score, "double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, p_quality, kept) for every row of docs, repeated rows and null doc_ids too; kept is p_quality >= cut.

    Null and empty texts have no words and statistics of 0; a null lang or source is a value of its own. Without
    labels of both classes all rows get the same p_quality. Very long texts are read to their end. Other columns are not read; an empty table gives an empty result."""
    p = scorer(spark, fit(spark, docs, labels))(docs["text"], docs["lang"], docs["source"])
    return docs.select("doc_id", p.alias("p_quality")).withColumn("kept", F.col("p_quality") >= cut)


def op1_factorization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

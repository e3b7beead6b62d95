"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all ordered thresholds. x holds
log(1 + count) of hashed words and hashed word beginnings of 4 to 8 bytes. Only features that
differ between the classes are kept, so most of a text has weight zero and length adds no noise.

The labels are binary. Grades of severity come from them: 0 is not toxic; toxic documents get grade
1, 2 or 3 by tertile of their number of indicative features per 100 words, a feature being
indicative if its log odds ratio in the labelled sample is at least MIN_Z standard errors. So the grades say how much of a text is of the
kind that the labels call toxic, and not how a person would rank it.
The model has at most MAX_FEATURES features, those of the greatest |z|; the bound is on the fitted model, not on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, buffer_of, col, ints, read, slices, small_side, span_hash, words_of

BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
MAX_LABELLED = 20_000  # bound of the sample of labelled rows used for fitting
MAX_FEATURES = 5_000
MIN_Z, MIN_DOCS = 2.5, 4
GRADES = 4


@dataclass
class Model:
    slot: np.ndarray  # position in weight + 1 of each hash slot, 0 if it has none
    weight: np.ndarray
    theta: np.ndarray


def slots_of(text: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, hash slot) of every occurrence of a feature, and the number of words of each document."""
    buf = buffer_of(text)
    w = words_of(buf)
    doc, sums, size = w.doc(), buf.sums(), w.end - w.start
    docs, keys = [doc], [w.hash >> U64(64 - BITS)]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        docs.append(doc[long])
        keys.append((span_hash(sums, w.start[long], w.start[long] + n) ^ U64(n << 58)) >> U64(64 - BITS))
    return np.concatenate(docs), np.concatenate(keys).astype(np.int64), w.count


def _counts(doc: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    both, n = np.unique(doc * width + key, return_counts=True)
    return both // width, both % width, n


def _document_frequencies(batches):
    """Partial counts of one partition, so that a feature leaves it once."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for b in slices(batches, "text"):
        doc, key, _ = slots_of(col(b, "text"))
        d, k, _ = _counts(doc, key, 1 << BITS)
        toxic = ints(b, "toxic")[d] > 0
        for c in (0, 1):
            total[c] += np.bincount(k[toxic == c], minlength=1 << BITS)
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["slot", "clean", "toxic"])


def _selected_counts(slot):
    def run(batches):
        for b in slices(batches, "text"):
            doc, key, words = slots_of(col(b, "text"))
            at = slot.value[key]
            d, k, n = _counts(doc[at > 0], at[at > 0] - 1, 1 << BITS)
            lo = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
            pack = lambda x: pa.ListArray.from_arrays(pa.array(lo), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ints(b, "toxic")), pa.array(words.astype(np.int64)), pack(k), pack(n)], ["toxic", "words", "k", "n"])

    return run


def _sig(z):
    return 0.5 * (1 + np.tanh(z / 2))


def fit_ordinal(doc, key, x, grade, width, l2=2e-4, steps=400, rate=0.1):
    """Adam on the penalised likelihood. theta is kept ordered as a first value and positive steps."""
    levels = max(int(grade.max(initial=0)), 1)
    n = max(len(grade), 1)
    w, raw = np.zeros(width), np.concatenate([[1.0], np.zeros(levels - 1)])
    m, v = np.zeros(width + levels), np.zeros(width + levels)
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        s = np.bincount(doc, w[key] * x, len(grade))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sig(edge[grade + 1] - s), _sig(edge[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(key, (dh - dl)[doc] * x, width) / n + l2 * w
        g_theta = (np.bincount(grade, dl, levels + 1)[1:] - np.bincount(grade, dh, levels + 1)[:-1]) / n
        g_raw = np.cumsum(g_theta[::-1])[::-1]
        g_raw[1:] *= np.exp(raw[1:])
        g = np.concatenate([g_w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, raw = w - step[:width], raw - step[width:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def sample_of(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, limit: int, *extra: str) -> DataFrame:
    """(_id, text, label, extra columns): at most limit rows, one for each of the labelled documents that a hash of doc_id chooses. Null labels are
    left out; of several labels of a document the greatest counts, of several rows the one of the least text."""
    some = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max(label).cast("int").alias("_y"))
    some = some.orderBy(F.xxhash64("_l", F.lit(5)), "_l").limit(limit)
    rows = docs.join(small_side(some, limit), docs["doc_id"] == some["_l"])
    one = F.struct(docs["text"].isNull().alias("_no"), docs["text"].alias("text"), some["_y"].alias(label), *[docs[c].alias(c) for c in extra])
    return rows.select(docs["doc_id"].cast("long").alias("_id"), one.alias("_one")).groupBy("_id").agg(F.min("_one").alias("_one")).select("_id", "_one.*").drop("_no")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Without a labelled document of each class the model gives severity 0 to all."""
    sample = sample_of(spark, docs, labels, "toxic", limit)
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(1 << BITS, np.int32), np.zeros(1), np.full(GRADES - 1, 30.0))
    if len(n) < 2:
        return none
    df = sample.mapInArrow(_document_frequencies, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(f"c + t >= {MIN_DOCS}")
    odds = lambda a, total: (F.col(a) + 0.5) / (F.lit(total + 0.5) - F.col(a))
    z = F.log(odds("t", n[1]) / odds("c", n[0])) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = df.select("slot", z.alias("z")).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "slot").limit(MAX_FEATURES).toPandas()
    if not len(best):
        return none
    slot = none.slot.copy()
    slot[best["slot"].to_numpy()] = np.arange(1, len(best) + 1)
    shared = spark.sparkContext.broadcast(slot)
    rows = sample.mapInArrow(_selected_counts(shared), "toxic long, words long, k array<int>, n array<int>").toArrow()
    toxic, words = (rows[c].to_numpy() for c in ("toxic", "words"))
    size = np.array([len(x) for x in rows["k"]])
    doc = np.repeat(np.arange(len(toxic)), size)
    key, count = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("k", "n"))
    good = best["z"].to_numpy()[key] > 0
    density = np.bincount(doc[good], count[good], len(toxic)) * 100 / np.maximum(words, 1)
    grade = np.zeros(len(toxic), np.int64)
    bad = toxic > 0
    edges = np.quantile(density[bad], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade[bad] = 1 + np.searchsorted(edges, density[bad], "left")
    _, grade[bad] = np.unique(grade[bad], return_inverse=True)
    grade[bad] += 1
    weight, theta = fit_ordinal(doc, key, np.log1p(count), grade, len(best))
    return Model(slot, weight, theta)


SCORE = "struct<expected_severity:double,p_toxic:double,grade:int>"


def scorer(spark: SparkSession, model: Model):
    """text -> SCORE. Texts without any known feature, so null and empty ones too, get that of x = 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def score(text: pa.Array) -> pa.Array:
        m, parts = shared.value, []
        for b in slices([pa.record_batch([text], ["text"])], "text"):
            doc, key, _ = slots_of(b.column(0))
            at = m.slot[key]
            d, k, n = _counts(doc[at > 0], at[at > 0] - 1, 1 << BITS)
            parts.append(np.bincount(d, m.weight[k] * np.log1p(n), b.num_rows))
        s = np.concatenate(parts) if parts else np.zeros(0)
        above = 1 - _sig(m.theta[None, :] - s[:, None])  # P(grade >= k), k from 1
        each = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1), pa.int32())], ["expected_severity", "p_toxic", "grade"])

    return score


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, rejected) for every row of docs, repeated rows and
    null doc_ids too; rejected is p_toxic >= cut. Null and empty texts have the score of a text without known features, very long ones are read to
    their end. An empty table gives an empty result. Other columns are not read."""
    score = scorer(spark, fit(spark, docs, labels))
    return docs.select("doc_id", score(docs["text"]).alias("_s")).select("doc_id", "_s.*").withColumn("rejected", F.col("p_toxic") >= cut)


def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs without the rejected rows; columns as they are. Each row is judged on its own text, so repeated rows share their fate and a null doc_id
    doesn't matter; null, empty and very long texts as in severity(). An empty table gives an empty result."""
    score = scorer(spark, fit(spark, docs, labels))
    return docs.where(score(docs["text"])["p_toxic"] < cut)


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

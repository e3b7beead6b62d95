"""Leak detectors and their adjudication.

A signal is a row (part, column, detector, ltype, evidence, seq); seq keeps the order in which they fired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_number
from .association import auc
from .longform import categorical, numeric
from .profile import looks_like_dates, missingness_auc, one_class_presence

SIGNAL = "part string, column string, detector string, ltype string, evidence string"
NAME_TOKENS = tuple("_final _flag label outcome prediction proba score target".split())
STRONG = tuple("future-timestamp perfect-separation present-only-for-one-class target-like-name".split())


def _signals(df: DataFrame, part: str, detector: str, ltype: str, evidence: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), "column", F.lit(detector).alias("detector"), F.lit(ltype).alias("ltype"), evidence.alias("evidence"))


def name_signals(spark: SparkSession, columns: list[str], target: str | None) -> DataFrame:
    hits = [("C", c, "target-like-name", "direct", c.lower()) for c in columns if c != target and any(t in c.lower() for t in NAME_TOKENS)]
    return spark.createDataFrame(hits, SIGNAL)


def effect_outliers(effects: DataFrame, least: int = 5, cut: float = 3.5) -> DataFrame:
    """Effects (column, metric_name, effect) far over those of the same metric, in units of the median deviation from the
    median. Metrics with fewer than least effects are passed by."""
    e = effects.where(F.col("effect").isNotNull() & ~F.isnan("effect"))
    own = Window.partitionBy("metric_name")
    m = e.withColumns({"n": F.count(F.lit(1)).over(own), "med": F.median("effect").over(own)})
    d = m.withColumn("mad", F.median(F.abs(F.col("effect") - F.col("med"))).over(own))
    mad = F.when(d["mad"] == 0, 1e-9).otherwise(d["mad"])
    hit = d.where((F.col("n") >= least) & ((F.col("effect") - F.col("med")) / (1.4826 * mad) > cut))
    return _signals(hit, "F", "outlier-effect-vs-peers", "direct", F.format_string("%.3f", "effect"))


def effect_backstop(effects: DataFrame, threshold: float | Column) -> DataFrame:
    return _signals(effects.where(F.col("effect") >= threshold), "F", "effect-above-backstop", "direct", F.format_string("%.3f", "effect"))


def separation(df: DataFrame, y: Column, features: list[str], min_count: int = 5, few: int = 10) -> DataFrame:
    """Columns that all but separate a 0/1 target: strings, and numbers of at most few values, by a level of one class;
    numbers without such a level by an AUC of 0.999."""
    cat = categorical(df, features, y).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    nums = [f for f in features if is_number(df.schema[f].dataType)]
    pure = cat.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"), F.bool_or((F.col("n") >= min_count) & F.col("m").isin(0.0, 1.0)).alias("pure"))
    by_level = pure.where(F.col("pure") & (~F.col("feature").isin(nums) | (F.col("levels") <= few))).select(F.col("feature").alias("column"), F.lit("pure level").alias("e"))
    found = _signals(by_level, "F", "perfect-separation", "direct", F.col("e"))
    if not nums:
        return found
    area = auc(numeric(df, nums, y), ["feature"]).where("effect >= 0.999").select(F.col("feature").alias("column"), "effect").join(by_level.select("column"), "column", "left_anti")
    return found.unionByName(_signals(area, "F", "perfect-separation", "direct", F.format_string("AUC %.3f", "effect")))


def future_timestamps(df: DataFrame, reference: Column, skip: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """Date columns, and strings that read as dates, with a value after the row's reference. Numbers are never read as dates."""
    columns = [c for c in looks_like_dates(df, columns) if c not in skip]
    if not columns:
        return df.sparkSession.createDataFrame([], SIGNAL)
    read = lambda c: (F.try_to_timestamp(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)).cast("timestamp")
    parsed = df.select(reference.cast("timestamp").alias("__ref"), *[read(c).alias(c) for c in columns])
    after = [F.avg(F.coalesce(F.col(c) > F.col("__ref"), F.lit(False)).cast("double")).alias(c) for c in columns]
    has = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}\0") for c in columns]
    both = parsed.agg(*after, *has)
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("f"), F.col(f"`{c}\0`").alias("p")) for c in columns])).alias("r")).select("r.*")
    return _signals(rows.where("p >= 0.8 and f > 0"), "D", "future-timestamp", "future", F.concat(F.format_string("%.1f", F.col("f") * 100), F.lit("% after ref")))


def presence_signals(df: DataFrame, y: Column, columns: list[str]) -> DataFrame:
    hit = one_class_presence(df, y, columns)
    return _signals(hit, "D", STRONG[2], "execution", F.format_string("p1=%.2f p0=%.2f", "present1", "present0"))


def missingness_signals(df: DataFrame, y: Column, columns: list[str], threshold: float = 0.70) -> DataFrame:
    hit = missingness_auc(df, y, columns).where(F.col("auc") >= threshold)
    return _signals(hit, "D", "missingness-predicts-target", "execution", F.format_string("AUC %.3f", "auc"))


def register(signals: list[DataFrame]) -> DataFrame:
    """The signals in the order of the list, then by column."""
    numbered = [s.withColumn("batch", F.lit(i)) for i, s in enumerate(signals)]
    return reduce(DataFrame.unionByName, numbered).withColumn("seq", F.row_number().over(Window.orderBy("batch", "column"))).drop("batch")


def adjudicate(signals: DataFrame) -> DataFrame:
    """(column, leak): a column is a suspect if a strong detector fired or at least two different ones did. leak is
    'detector:ltype' of the first strong (else first) signal and the number of further detectors."""
    strong = F.col("detector").isin(*STRONG)
    first = F.min_by(F.struct("detector", "ltype"), "seq")
    g = signals.groupBy("column").agg(F.count_distinct("detector").alias("k"), F.bool_or(strong).alias("any"), F.min_by(F.when(strong, F.struct("detector", "ltype")), F.when(strong, F.col("seq"))).alias("s"), first.alias("w"))
    lead = F.coalesce("s", "w")
    more = F.when(F.col("k") > 1, F.concat(F.lit(" (+"), (F.col("k") - 1).cast("string"), F.lit(")"))).otherwise("")
    return g.where("any or k > 1").select("column", F.concat(lead["detector"], F.lit(":"), lead["ltype"], more).alias("leak"))

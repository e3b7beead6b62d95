"""Rankings, counts and views over a ledger (one row for each column of the screened table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import number

GONE = ("drop", "structural-drop", "redundant")


def rank_within_type(ledger: DataFrame) -> DataFrame:
    """(column, rank): by effect within the semantic type (null is a type), no effect last, then by name."""
    w = Window.partitionBy("semantic_type").orderBy(F.col("effect").desc_nulls_last(), "column")
    return ledger.withColumn("effect", number("effect")).select("column", F.row_number().over(w).alias("rank"))


def _top(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("effect").desc_nulls_last(), "column").limit(n)


def top_keeps(ledger: DataFrame, n: int = 10) -> DataFrame:
    return _top(ledger.where("verdict = 'keep'"), n).select(*"column semantic_type metric_name effect reason".split())


def effect_ranking(ledger: DataFrame, semantic_type: str | None = None, n: int = 20) -> DataFrame:
    found = ledger.where("effect is not null")
    return _top(found if semantic_type is None else found.where(F.col("semantic_type") == semantic_type), n).select("column", "effect")


def missingness_top(missing: DataFrame, n: int = 15) -> DataFrame:
    return missing.orderBy(F.col("missing").desc(), "column").limit(n)


def drop_rate_by_rule(ledger: DataFrame) -> DataFrame:
    """(rule, n): dropped columns by the start of their reason, up to a bracket or quote; no reason is the empty rule."""
    rule = F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), "[('\"][\\s\\S]*", ""))
    return ledger.where(F.col("verdict").isin(*GONE)).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def scorecard(ledger: DataFrame) -> DataFrame:
    """(item, name, n): the number of columns, and of each verdict and dropping rule."""
    total = ledger.agg(F.lit("columns").alias("item"), F.lit("").alias("name"), F.count(F.lit(1)).alias("n"))
    verdicts = ledger.where("verdict is not null").groupBy(F.lit("verdict").alias("item"), F.col("verdict").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return total.unionByName(verdicts).unionByName(drop_rate_by_rule(ledger).select(F.lit("rule").alias("item"), F.col("rule").alias("name"), "n"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal width from the least to the greatest value, empty bins left out."""
    x = df.select(number(column).alias("x")).where("x is not null")
    edge = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0)
    return x.crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def similarity_matrix(pairs: DataFrame) -> DataFrame:
    """The edge list as a square: one row for each column, 1 on the diagonal."""
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("score"))
    return both.unionByName(own).groupBy(F.col("a").alias("column")).pivot("b").agg(F.first("score"))


def review_worklist(ledger: DataFrame) -> DataFrame:
    return ledger.where("verdict = 'review'")


def ledger_view(ledger: DataFrame) -> DataFrame:
    return ledger.select(*[c for c in "column semantic_type verdict metric_name effect reason".split() if c in ledger.columns])


def inventory_view(facts: DataFrame) -> DataFrame:
    shown = [c for c in "column semantic_type dtype n_unique missing_rate".split() if c in facts.columns]
    return facts.select(*shown) if shown else facts


LIMITS = (
    "Limits. The ledger screens columns; a person chooses among them. It can't see errors in how the frame was set up (grain, "
    "unclear negatives, survivors only), nor columns that matter only together. Columns that were dropped stay listed here."
)

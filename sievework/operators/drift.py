"""Population stability index and variance inflation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket, number
from .ranking import quantiles

LEAST = 1e-6


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Distinct inner quantiles of the values; none for an empty column."""
    c = df.select(number(column).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    found = quantiles(c, [], "x", [k / bins for k in range(bins + 1)]).first()
    return sorted(set(found["q"]))[1:-1] if found else []


def bin_counts(df: DataFrame, column: str, edges: list[float], name: str = "n") -> DataFrame:
    x = df.select(number(column).alias("x")).where("x is not null")
    return x.groupBy(bucket(F.col("x"), edges).alias("bin")).agg(F.count(F.lit(1)).alias(name))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row (psi, bins): shares in quantile bins of expected, clipped at LEAST. Null if a side is empty."""
    return psi_of_edges(expected, actual, column, quantile_edges(expected, column, bins))


def psi_of_edges(expected: DataFrame, actual: DataFrame, column: str, edges: list[float]) -> DataFrame:
    both = bin_counts(expected, column, edges, "e").join(bin_counts(actual, column, edges, "a"), "bin", "full").na.fill(0, ["e", "a"])
    every = expected.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin")).join(both, "bin", "left").na.fill(0, ["e", "a"])
    total = every.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = lambda c, t: F.greatest(F.col(c) / F.nullif(F.col(t), F.lit(0)), F.lit(LEAST))
    e, a = share("e", "te"), share("a", "ta")
    part = F.when((F.col("te") > 0) & (F.col("ta") > 0), (a - e) * F.log(a / e))
    return every.crossJoin(F.broadcast(total)).agg(F.sum(part).alias("psi"), F.count(F.lit(1)).alias("bins"))


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others, rows with a null left out: the diagonal of the inverse
    correlation matrix, whose sums are made in one pass without a shuffle of rows."""
    rows = df.select(*[number(c).alias(c) for c in columns]).dropna()
    m = Correlation.corr(VectorAssembler(inputCols=columns, outputCol="v").transform(rows), "v").head()
    r = np.asarray(m[0].toArray())
    try:
        inverse = np.diag(np.linalg.inv(r))
    except np.linalg.LinAlgError:
        return {c: float("inf") for c in columns}
    return {c: float(v) if v >= 0 else float("inf") for c, v in zip(columns, inverse, strict=True)}

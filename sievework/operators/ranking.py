"""Ranks, row numbers and quantiles of long groups without putting a group into one task.

Rows are range-partitioned by group and order and written. Running sums are taken inside each
partition; only the partitions' totals, about as many rows as there are partitions and groups, are summed over
partitions. They are broadcast where groups are features, folds and the like, or if their written size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep, small


FEW = {"feature", "fold", "b", "rep"}  # groups of which there are as many as columns, folds or replicates


def cumulative(df: DataFrame, by: list[str], order: list[Column | str], value: str | None = None, into: str = "before") -> DataFrame:
    """df with the sum of value (1 if None) over the rows before in the group. Group columns must not be null; rows
    that are equal in order follow each other in any order."""
    n = F.lit(1).cast("long") if value is None else F.col(value)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.repartitionByRange(tasks, *[F.col(c) for c in by], *order).withColumn("__p", F.spark_partition_id()))
    inner = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__p")
    totals = ranged.groupBy("__p", *by).agg(F.sum(n).alias("__t"))
    start = totals.select("__p", *by, (F.sum("__t").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__t")).alias("__b"))
    start = F.broadcast(start) if set(by) <= FEW else small(keep(start))
    summed = ranged.withColumn("__s", F.sum(n).over(inner) - n).join(start, ["__p", *by])
    return summed.withColumn(into, F.col("__s") + F.col("__b")).drop("__p", "__s", "__b")


def doubled_ranks(cells: DataFrame, by: list[str], value: str, n: str = "n", into: str = "r2") -> DataFrame:
    """cells (one row for each by and value, n rows each) with twice the average rank of the value, an integer."""
    return cumulative(cells, by, [F.col(value)], n, "__before").withColumn(into, 2 * F.col("__before") + F.col(n) + 1).drop("__before")


def row_numbers(df: DataFrame, by: list[str], order: list[Column | str], into: str = "rn") -> DataFrame:
    """df with its number in the group, from 0."""
    return cumulative(df, by, order, None, into)


def quantiles(cells: DataFrame, by: list[str], value: str, qs: list[float], n: str = "n") -> DataFrame:
    """(by, q as list): exact quantiles with linear interpolation, in the order of qs."""
    placed = cumulative(cells, by, [F.col(value)], n)
    total = cells.groupBy(*by).agg(F.sum(n).alias("__n"))
    return quantiles_of(placed, total, by, value, qs, n)


def quantiles_of(placed: DataFrame, total: DataFrame, by: list[str], value: str, qs: list[float], n: str = "n") -> DataFrame:
    at = [(F.col("__n") - 1) * F.lit(float(q)) for q in qs]
    asked = total.select(*by, F.posexplode(F.array(*at)).alias("__k", "__h"))
    lower, last = F.floor("__h"), F.col("before") + F.col(n)
    touch = (F.col("before") <= F.ceil("__h")) & (last > lower)
    near = placed.join(F.broadcast(asked), by).where(touch) if by else placed.crossJoin(F.broadcast(asked)).where(touch)
    lo = F.max(F.when((F.col("before") <= lower) & (lower < last), F.col(value)))
    hi = F.max(F.when((F.col("before") <= F.ceil("__h")) & (F.ceil("__h") < last), F.col(value)))
    found = near.groupBy(*by, "__k", "__h").agg(lo.alias("__lo"), hi.alias("__hi"))
    point = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - lower)
    listed = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("__k"), point.alias("v")))).alias("__q"))
    return listed.select(*by, F.expr("transform(__q, x -> x.v)").alias("q"))

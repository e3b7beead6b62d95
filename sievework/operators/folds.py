"""Frozen cross-validation folds as a table of row keys.

fold is 1 to k where every row is tested once. For time, fold 0 is tested never and fold f is trained on all folds
before it. The order of rows within a class comes from an MD5 of seed and key, so folds don't depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import keep, small
from .ranking import row_numbers


@dataclass(frozen=True)
class Folds:
    frame: DataFrame  # (row_key, fold)
    strategy: str
    k: int
    seed: int

    def is_test(self, fold: Column, f: int) -> Column:
        return fold == f

    def is_train(self, fold: Column, f: int) -> Column:
        return fold < f if self.strategy == "time" else fold != f

    def is_screened(self, fold: Column) -> Column:
        """In the training rows of some fold."""
        return fold < self.k if self.strategy == "time" else F.lit(True)

    def save(self, path: str) -> None:
        self.frame.withColumns({"strategy": F.lit(self.strategy), "k": F.lit(self.k), "seed": F.lit(self.seed)}).write.mode("overwrite").parquet(path)


def load_folds(spark: SparkSession, path: str) -> Folds:
    df = spark.read.parquet(path)
    one = df.select("strategy", "k", "seed").first()
    if one is None:
        raise ValueError(f"{path} has no rows")
    return Folds(df.select("row_key", "fold"), one["strategy"], one["k"], one["seed"])


def make_folds(df: DataFrame, strategy: str, k: int = 5, *, key: str = "row_key", date=None, group=None, target=None, seed: int = 42) -> Folds:
    """strategy is 'time' (date given), 'grouped' (group), 'stratified' (target; null is a class of its own), or anything else for plain folds."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    turn = (F.col("rn") % k + 1).cast("int")
    if strategy == "time":
        _needs(date, "time folds need a date column")
        ts = F.try_to_timestamp(F.col(date)) if dict(df.dtypes)[date] == "string" else F.col(date)
        rows = df.select(F.col(key).alias("row_key"), ts.alias("t"))
        n = rows.count()
        test = n // (k + 1)
        numbered = row_numbers(rows, [], [F.col("t").asc_nulls_last(), F.col("row_key")])
        first = n - k * test
        made = numbered.select("row_key", F.when(F.col("rn") < first, 0).otherwise(F.floor((F.col("rn") - first) / max(test, 1)) + 1).cast("int").alias("fold"))
    elif strategy == "grouped":
        _needs(group, "grouped folds need a group column")
        made = _grouped(df.select(F.col(key).alias("row_key"), F.col(group).alias("g")), k)
    elif strategy == "stratified":
        _needs(target, "stratified folds need a target column")
        rows = df.select(F.col(key).alias("row_key"), F.coalesce(F.col(target).cast("string"), F.lit("\0")).alias("c"), mixed.alias("h"))
        made = row_numbers(rows, ["c"], ["h", "row_key"]).select("row_key", turn.alias("fold"))
    else:
        made = row_numbers(df.select(F.col(key).alias("row_key"), mixed.alias("h")), [], ["h", "row_key"]).select("row_key", turn.alias("fold"))
    return Folds(keep(made), strategy, k, seed)


def _needs(column: str | None, message: str) -> None:
    if column is None:
        raise ValueError(message)


def _dealt(load: list[int], size: int, groups: int) -> list[int]:
    """How many of equal groups each fold gets if they go one by one to the fold with the fewest rows, the first of equal ones."""
    below = lambda level: [max(0, -(-(level - v) // size)) for v in load]  # noqa: E731  so many of a fold's turns come under a level
    lo, hi = min(load), max(load) + size * (groups + 1)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if sum(below(middle)) <= groups else (lo, middle)
    out = below(lo)
    rest = groups - sum(out)
    for f in sorted(range(len(load)), key=lambda f: (load[f] + size * out[f], f))[:rest]:
        out[f] += 1
    return out


def _grouped(rows: DataFrame, k: int) -> DataFrame:
    """Groups stay whole and go, the largest first, each to the fold with the fewest rows. Groups of one size are alike, so the driver deals only the distinct
    sizes, of which n rows can't have more than the root of 2n; within a size, groups are numbered and the first go to the first fold."""
    sizes = keep(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    load, ranges = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("n").desc()).collect():
        at = 0
        for f, m in enumerate(_dealt(load, r["n"], r["m"])):
            if m:
                ranges.append((r["n"], at, at + m, f + 1))
            at, load[f] = at + m, load[f] + r["n"] * m
    spark = rows.sparkSession
    table = small(keep(spark.createDataFrame(ranges, "n long, lo long, hi long, fold int")))
    numbered = row_numbers(sizes, ["n"], ["g"]).join(table, "n").where("rn >= lo and rn < hi").select(F.col("g").alias("__g"), "fold")
    return rows.join(numbered, F.col("g").eqNullSafe(F.col("__g"))).select("row_key", "fold")


def fold_positives(df: DataFrame, folds: Folds, target: str, positive=None, key: str = "row_key") -> DataFrame:
    """(fold, positives) in each test block; the positive value is the rarest (the first of equals) unless given."""
    if positive is None:
        least = df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy("count", target).first()
        positive = least[0] if least else None
    y = df.select(F.col(key).alias("row_key"), (F.col(target) == F.lit(positive)).alias("p"))
    return folds.frame.where("fold > 0").join(y, "row_key").groupBy("fold").agg(F.count_if("p").alias("positives"))

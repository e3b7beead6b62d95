"""Weight of evidence, information value (in and out of fold), target encoding out of fold, shape gap."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .association import _d
from .folds import Folds
from .ranking import cumulative, quantiles_of

SMOOTH = 0.5


def level_cells(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, g, b): rows with y = 0 and y = 1 by level."""
    return long.groupBy(*by, "x").agg(F.count_if(F.col("y") == 0).alias("g"), F.count_if(F.col("y") == 1).alias("b"))


def woe_table(levels: DataFrame, by: list[str], smooth: float = SMOOTH) -> DataFrame:
    """levels with woe = ln of the smoothed share of y = 0 over that of y = 1, and iv, the level's part of the information value."""
    total = levels.groupBy(*by).agg(F.sum("g").alias("tg"), F.sum("b").alias("tb"))
    s = F.lit(smooth)
    t = levels.join(F.broadcast(total), by)
    woe = F.log((F.col("g") + s) / (F.col("tg") + s) / ((F.col("b") + s) / (F.col("tb") + s)))
    t = t.where("tg > 0 and tb > 0").withColumn("woe", woe)
    return t.withColumn("iv", (F.col("g") / F.col("tg") - F.col("b") / F.col("tb")) * F.col("woe")).drop("tg", "tb")


def merge_levels(levels: DataFrame, by: list[str], least: float = 0.05) -> DataFrame:
    """(by, x, bin): levels in the order of their event rate are joined until a bin has at least that share of the rows.
    A feature's levels are one task; there are far fewer of them than rows."""
    kinds = dict(levels.dtypes)

    def one(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.assign(rate=t["b"] / (t["g"] + t["b"])).sort_values(["rate", "x"])
        need, held, bins, now = least * (t["g"] + t["b"]).sum(), 0.0, [], 0
        left = float((t["g"] + t["b"]).sum())
        for n in t["g"] + t["b"]:
            bins.append(now)
            held, left = held + n, left - n
            if held >= need and left >= need:
                now, held = now + 1, 0.0
        out = t[[*by, "x"]].copy()
        out["bin"] = [str(b) for b in bins]
        return out

    return levels.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in [*by, "x"]) + ", bin string")


def information_value(long: DataFrame, by: list[str], smooth: float = SMOOTH, binning: str = "level") -> DataFrame:
    """(by, n, effect). binning is 'level' (each level a bin) or 'merge' (see merge_levels). Null for a single class."""
    levels = level_cells(long, by)
    if binning == "merge":
        levels = levels.join(merge_levels(levels, by), [*by, "x"]).groupBy(*by, F.col("bin").alias("x")).agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    found = woe_table(levels, by, smooth).groupBy(*by).agg(F.sum("iv").alias("effect"))
    return levels.groupBy(*by).agg(F.sum(F.col("g") + F.col("b")).alias("n")).join(found, by, "left")


def _per_fold(cells: DataFrame, by: list[str], folds: Folds, sums: list[str]) -> DataFrame:
    """cells by (by, x, fold) as (by, f, x, and for each sum s: te_s, tr_s): its test and train parts in fold f."""
    def part(f: int, s: str, role: str) -> Column:
        inside = folds.is_test(F.col("fold"), f) if role == "te" else folds.is_train(F.col("fold"), f)
        return F.sum(F.when(inside, F.col(s)).otherwise(F.lit(0))).alias(f"{role}_{s}_{f}")

    fs = range(1, folds.k + 1)
    wide = cells.groupBy(*by, "x").agg(*[part(f, s, role) for f in fs for s in sums for role in ("te", "tr")])
    rows = F.array(*[F.struct(F.lit(f).alias("f"), *[F.col(f"{role}_{s}_{f}").alias(f"{role}_{s}") for s in sums for role in ("te", "tr")]) for f in fs])
    return wide.select(*by, "x", F.explode(rows).alias("e")).select(*by, "x", "e.*")


def iv_oof(long: DataFrame, by: list[str], folds: Folds) -> DataFrame:
    """(by, n, effect): weights of evidence of each fold's training rows on the shares of its test rows, mean over the folds in
    which both parts have both classes. A level that training rows lack weighs 0. long has fold."""
    levels = long.groupBy(*by, "x", "fold").agg(F.count_if(F.col("y") == 0).alias("g"), F.count_if(F.col("y") == 1).alias("b"))
    t = _per_fold(levels, by, folds, ["g", "b"])
    total = t.groupBy(*by, "f").agg(*[F.sum(c).alias(f"t_{c}") for c in ("te_g", "te_b", "tr_g", "tr_b")]).where("t_te_g > 0 and t_te_b > 0 and t_tr_g > 0 and t_tr_b > 0")
    s = F.lit(SMOOTH)
    woe = F.when(F.col("tr_g") + F.col("tr_b") > 0, F.log((F.col("tr_g") + s) / (F.col("t_tr_g") + s) / ((F.col("tr_b") + s) / (F.col("t_tr_b") + s)))).otherwise(0.0)
    part = (F.col("te_g") / F.col("t_te_g") - F.col("te_b") / F.col("t_te_b")) * woe
    found = t.join(F.broadcast(total), [*by, "f"]).groupBy(*by, "f").agg(F.sum(part).alias("iv")).groupBy(*by).agg(F.avg("iv").alias("effect"))
    return levels.groupBy(*by).agg(F.sum(F.col("g") + F.col("b")).alias("n")).join(found, by, "left")


def target_eta_oof(long: DataFrame, by: list[str], folds: Folds) -> DataFrame:
    """(by, n, effect): 1 - SSres / SStot (not under 0) of test rows against the training mean of their category, or of all
    where it is null or unseen, pooled over the folds; 0 if the target doesn't vary. long has fold, and rows with x null."""
    y = _d("y")
    return eta_of_cells(long.groupBy(*by, "x", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")), by, folds)


def eta_of_cells(c: DataFrame, by: list[str], folds: Folds) -> DataFrame:
    """The same from (by, x, fold, n, s, q): number, sum and sum of squares of y."""
    t = _per_fold(c, by, folds, ["n", "s", "q"])
    total = t.groupBy(*by, "f").agg((F.sum("tr_s") / F.sum("tr_n")).alias("mean")).where("mean is not null")
    enc = F.when(F.col("x").isNotNull() & (F.col("tr_n") > 0), F.col("tr_s") / F.nullif(F.col("tr_n"), F.lit(0))).otherwise(F.col("mean"))
    j = t.join(F.broadcast(total), [*by, "f"]).withColumn("e", enc)
    res = F.sum(F.col("te_q") - 2 * F.col("e") * F.col("te_s") + F.col("e") * F.col("e") * F.col("te_n"))
    g = j.groupBy(*by).agg(res.alias("res"), F.sum("te_n").alias("n"), F.sum("te_s").alias("s"), F.sum("te_q").alias("q"))
    tot = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return g.select(*by, "n", F.when(tot > 0, F.greatest(F.lit(0.0), 1 - F.col("res") / tot)).otherwise(0.0).alias("effect"))


def x_statistic(long: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, x_stat, effect): area under the ROC curve of the event rate of quantile bins, which any monotone function of the
    rate shares, and of x itself."""
    c = long.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("m"))
    placed = cumulative(c, by, [F.col("x")], "n")
    total = c.groupBy(*by).agg(F.sum("n").alias("__n"), F.sum("m").alias("pos"))
    edges = quantiles_of(placed, total.drop("pos"), by, "x", [k / bins for k in range(1, bins)]).withColumn("q", F.array_distinct("q"))
    binned = c.join(F.broadcast(edges), by).groupBy(*by, F.size(F.filter("q", lambda e: e <= F.col("x"))).alias("bin")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    rated = binned.groupBy(*by, (F.col("m") / F.col("n")).alias("rate")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    def area(t: DataFrame, r2: Column, name: str) -> DataFrame:
        g = t.groupBy(*by).agg((F.sum(_d(r2) * _d("m")) / 2).alias("s"), F.sum("m").alias("p"), F.sum("n").alias("k"))
        a = (F.col("s") - _d("p") * (_d("p") + 1) / 2) / (_d("p") * (_d("k") - _d("p")))
        return g.where("p > 0 and p < k").select(*by, F.greatest(a, 1 - a).alias(name))

    few = Window.partitionBy(*by).orderBy("rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most bins rows
    x = area(rated.withColumn("r2", 2 * F.sum("n").over(few) - F.col("n") + 1), F.col("r2"), "x_stat")
    return x.join(area(placed.withColumn("r2", 2 * F.col("before") + F.col("n") + 1), F.col("r2"), "effect"), by)


def shape_gap(long: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, gap): what the area of the raw feature misses because the relation isn't monotone; may be a little under 0."""
    return x_statistic(long, by, bins).select(*by, (F.col("x_stat") - F.col("effect")).alias("gap"))


def iv_of_counts(g: list[float], b: list[float], smooth: float = SMOOTH) -> float:
    """The information value of one small table, on the driver."""
    tg, tb = sum(g), sum(b)
    if not tg or not tb:
        return float("nan")
    return sum((x / tg - y / tb) * math.log((x + smooth) / (tg + smooth) / ((y + smooth) / (tb + smooth))) for x, y in zip(g, b, strict=True))

"""Effect of a feature on a target, for many features (or features and folds) in one plan.

Each function takes a long table with the columns of by, x and y and gives one row for each group. Rows
are counted into cells first; ranks come from ranking.doubled_ranks, so no group has to fit in one task. A
group without a defined effect has a null effect.
"""

from __future__ import annotations

import numpy as np
import pandas
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_p, corr_p, normal_p
from .longform import cells
from .ranking import doubled_ranks


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _rank_sums(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, neg, n, s, ties): s is the rank sum of the rows with y = 1, ties the sum of t^3 - t. y is 0 or 1."""
    c = long.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("m"))
    r = doubled_ranks(c, by, "x")
    n = _d("n")
    return r.groupBy(*by).agg(F.sum("m").alias("pos"), F.sum("n").alias("n"), (F.sum(_d("r2") * _d("m")) / 2).alias("s"), F.sum(n * n * n - n).alias("ties")).withColumn("neg", F.col("n") - F.col("pos"))


def _u() -> Column:
    return F.col("s") - _d("pos") * (_d("pos") + 1) / 2


def _area() -> Column:
    return F.when((F.col("pos") > 0) & (F.col("neg") > 0), _u() / (_d("pos") * _d("neg")))


def auc(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect): the larger of the area under the ROC curve and its complement."""
    return _rank_sums(long, by).select(*by, "n", F.greatest(_area(), 1 - _area()).alias("effect"))


def mann_whitney(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect, u, z, p): p by the normal approximation, corrected for ties and continuity."""
    n, m, k = _d("n"), _d("pos"), _d("neg")
    sd = F.sqrt(m * k / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(_area().isNotNull() & (sd > 0), F.greatest(F.abs(_u() - m * k / 2) - 0.5, F.lit(0.0)) / sd)
    t = _rank_sums(long, by).select(*by, "n", F.greatest(_area(), 1 - _area()).alias("effect"), _u().alias("u"), z.alias("z"))
    return t.withColumn("p", normal_p("z"))


def cliffs_delta(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect): P(x1 > x0) - P(x1 < x0), signed; y = 1 is the upper level."""
    return _rank_sums(long, by).select(*by, "n", (2 * _area() - 1).alias("effect"))


def _class_ranks(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, n, r2, per): counts of the classes y of each value."""
    c = cells(long, by, "x", "y").groupBy(*by, "x").agg(F.sum("n").alias("n"), F.collect_list(F.struct("y", F.col("n").alias("k"))).alias("per"))
    return doubled_ranks(c, by, "x")


def auc_ovr(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect): mean over the classes of the area of each against the rest, either way round."""
    r = _class_ranks(long, by).select(*by, "r2", F.explode("per").alias("e")).select(*by, "r2", "e.*")
    per = r.groupBy(*by, "y").agg(F.sum("k").alias("pos"), (F.sum(_d("r2") * _d("k")) / 2).alias("s"))
    total = per.groupBy(*by).agg(F.sum("pos").alias("n"))
    area = per.join(F.broadcast(total), by).withColumn("neg", F.col("n") - F.col("pos"))
    return area.groupBy(*by).agg(F.max("n").alias("n"), F.avg(F.greatest(_area(), 1 - _area())).alias("effect"))


def kruskal(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, h, effect, p): tie-corrected H, epsilon squared H / (n - 1), chi-square tail."""
    r = _class_ranks(long, by)
    n = _d("n")
    ties = r.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * n * n - n).alias("ties"))
    per = r.select(*by, "r2", F.explode("per").alias("e")).groupBy(*by, "e.y").agg(F.sum("e.k").alias("k"), (F.sum(_d("r2") * _d("e.k")) / 2).alias("s"))
    sums = per.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.count(F.lit(1)).alias("groups")).join(F.broadcast(ties), by)
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    fit = (F.col("groups") > 1) & (F.col("ties") < n * n * n - n)
    out = sums.select(*by, "n", F.when(fit, h).alias("h"), (F.col("groups") - 1).alias("df"))
    return out.withColumn("effect", F.col("h") / (F.col("n") - 1)).withColumn("p", chi2_p("h", _d("df"))).drop("df")


def pearson(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, r, effect, p): effect is the absolute correlation; point-biserial where y is 0 or 1."""
    x, y = _d("x"), _d("y")
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    g = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    return g.withColumn("effect", F.abs("r")).withColumn("p", corr_p("r", _d("n")))


def spearman(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, r, effect, p): Pearson correlation of the average ranks."""
    c = cells(long, by, "x", "y")
    rx = doubled_ranks(c.groupBy(*by, "x").agg(F.sum("n").alias("nx")), by, "x", "nx", "rx").drop("nx")
    ry = doubled_ranks(c.groupBy(*by, "y").agg(F.sum("n").alias("ny")), by, "y", "ny", "ry").drop("ny")
    j = c.join(rx, [*by, "x"]).join(ry, [*by, "y"])
    n, x, y = _d("n"), _d("rx"), _d("ry")
    g = j.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    mean = n * (n + 1) * (n + 1)  # twice an average rank has mean n + 1
    vx, vy = F.col("xx") - mean, F.col("yy") - mean
    g = g.select(*by, "n", F.when((vx > 0) & (vy > 0), (F.col("xy") - mean) / (F.sqrt(vx) * F.sqrt(vy))).alias("r"))
    return g.withColumn("effect", F.abs("r")).withColumn("p", corr_p("r", _d("n")))


def inversions(rank: np.ndarray, n: np.ndarray) -> int:
    """Weighted pairs i < j with rank[i] > rank[j], by merging runs of doubled length (numpy, O(n log n) a level)."""
    order, total, width = np.arange(len(rank)), 0, 1
    while width < len(rank):
        block = np.arange(len(rank)) // (2 * width)
        right = (np.arange(len(rank)) // width) % 2 == 1
        at = np.lexsort((right[...], rank[order], block))
        w, is_right = n[order][at], right[at]
        left_before = np.cumsum(np.where(is_right, 0, w))
        _, first, size = np.unique(block[at], return_index=True, return_counts=True)
        base = np.repeat(np.where(first > 0, left_before[np.maximum(first - 1, 0)], 0), size)
        per_block = np.repeat(np.add.reduceat(np.where(is_right, 0, w), first), size)
        total += int((np.where(is_right, w, 0) * (per_block - (left_before - base))).sum())
        order = order[at]
        width *= 2
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """tau-b of the weighted pairs (x, y)."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(np.int64)
    pairs = lambda k: int((k.astype(object) * (k.astype(object) - 1) // 2).sum())
    group = lambda v: np.bincount(np.unique(v, return_inverse=True)[1], n).astype(np.int64)
    total, tx, ty, both = pairs(np.array([n.sum()])), pairs(group(x)), pairs(group(y)), pairs(n)
    discordant = inversions(np.unique(y, return_inverse=True)[1], n)
    below = (total - tx) * (total - ty)
    return (total - tx - ty + both - 2 * discordant) / below**0.5 if below > 0 else float("nan")


def kendall(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect): tau-b, from the distinct cells of each group in one task, by merge counting."""
    kinds = dict(long.dtypes)

    def one(key: tuple, g: pandas.DataFrame) -> pandas.DataFrame:
        tau = kendall_tau(g["x"].to_numpy(), g["y"].to_numpy(), g["n"].to_numpy())
        return pandas.DataFrame([[*key, int(g["n"].sum()), None if tau != tau else tau]])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, effect double"
    return cells(long, by, "x", "y").groupBy(*by).applyInPandas(one, schema)


def eta_squared(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect): share of the variance of y between the categories x; 0 if y doesn't vary."""
    y = _d("y")
    g = long.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("k"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(F.lit(1))).alias("ssw"))
    t = g.groupBy(*by).agg(F.sum("k").alias("n"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"), F.sum("ssw").alias("within"))
    d = F.col("m") - F.col("mean")
    ssb = g.join(t.select(*by, "mean"), by).groupBy(*by).agg(F.sum(F.col("k") * d * d).alias("between"))
    total = F.col("between") + F.col("within")
    return t.join(ssb, by).select(*by, "n", F.when(total > 0, F.col("between") / total).otherwise(0.0).alias("effect"))


def contingency(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, r, k, chi2) of the table of x and y; empty cells need no row."""
    o = cells(long, by, "x", "y")
    rows, cols = (o.groupBy(*by, c).agg(F.sum("n").alias(f"n_{c}")) for c in ("x", "y"))
    share = _d("n") * _d("n") / (_d("n_x") * _d("n_y"))
    fit = o.join(rows, [*by, "x"]).join(cols, [*by, "y"]).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(share).alias("q"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("r")).join(cols.groupBy(*by).agg(F.count(F.lit(1)).alias("k")), by)
    return fit.join(sizes, by).select(*by, "n", "r", "k", (_d("n") * F.greatest(F.col("q") - 1, F.lit(0.0))).alias("chi2"))


def cramers_v(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect), not corrected for bias."""
    least = F.least("r", "k") - 1
    return contingency(long, by).select(*by, "n", F.when(least > 0, F.sqrt(F.col("chi2") / F.col("n") / F.nullif(least, F.lit(0)))).alias("effect"))


def bergsma_v(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, effect), Cramér's V corrected for bias."""
    n, r, k = _d("n"), _d("r"), _d("k")
    n1 = F.nullif(n - 1, F.lit(0.0))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (k - 1) / n1)
    least = F.least(r - (r - 1) * (r - 1) / n1, k - (k - 1) * (k - 1) / n1) - 1
    return contingency(long, by).select(*by, "n", F.when((F.least("r", "k") > 1) & (least > 0), F.sqrt(phi / least)).alias("effect"))

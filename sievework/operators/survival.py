"""Univariate Cox models, concordance and log-rank tests.

Rows are summed by distinct duration; risk sets are running sums over that table, from the longest duration down, and not
over rows. All features are fitted together, one job for each Newton step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.tails import chi2_tail, normal_two_sided
from ..sources.scratch import keep


def _long(df: DataFrame, duration: str, event: str, features: list[str]) -> DataFrame:
    wide = df.select(number(duration).alias("t"), number(event).alias("e"), *[number(f).alias(f) for f in features])
    return wide.unpivot(["t", "e"], features, "feature", "x").where("t is not null and e is not null and x is not null")


def _risk_sums(rows: DataFrame, beta: dict[str, float], center: dict[str, float]) -> DataFrame:
    at = F.create_map(*[v for f in beta for v in (F.lit(f), F.lit(float(beta[f])))])
    mid = F.create_map(*[v for f in center for v in (F.lit(f), F.lit(float(center[f])))])
    x = F.col("x") - mid[F.col("feature")]
    r = F.exp(at[F.col("feature")] * x)
    dead = F.col("e") > 0
    sums = {"s0": r, "s1": x * r, "s2": x * x * r}
    parts = [F.sum(v).alias(k) for k, v in sums.items()] + [F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d{k[1]}") for k, v in sums.items()]
    g = rows.groupBy("feature", "t").agg(*parts, F.count_if(dead).alias("d"), F.sum(F.when(dead, x).otherwise(0.0)).alias("dx"))
    down = Window.partitionBy("feature").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("feature", "d", "dx", "d0", "d1", "d2", *[F.sum(s).over(down).alias(f"r{s[1]}") for s in sums]).where("d > 0")


def _newton_terms(risk: DataFrame, efron: bool) -> DataFrame:
    """(feature, u, i): score and information. Ties by Efron's (or Breslow's) sums."""
    steps = F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))
    t = risk.withColumn("l", F.explode(steps)) if efron else risk.withColumn("l", F.lit(0))
    share = F.col("l") / F.col("d") if efron else F.lit(0.0)
    w = F.lit(1.0) if efron else F.col("d")
    s = [F.col(f"r{k}") - share * F.col(f"d{k}") for k in range(3)]
    mean = s[1] / s[0]
    u = F.when(F.col("l") == 0, F.col("dx")).otherwise(0.0) - w * mean
    return t.groupBy("feature").agg(F.sum(u).alias("u"), F.sum(w * (s[2] / s[0] - mean * mean)).alias("i"))


def cox_screen(df: DataFrame, duration: str, event: str, features: list[str], efron: bool = True, steps: int = 25) -> dict[str, dict[str, float]]:
    """feature -> {beta, hr, se, p, cindex}; p of the Wald test. A feature without events or variation has NaN."""
    rows = keep(_long(df, duration, event, features))
    facts = {r["feature"]: r for r in rows.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count_if(F.col("e") > 0).alias("d")).collect()}
    center = {f: facts[f]["m"] if f in facts else 0.0 for f in features}
    beta, info = dict.fromkeys(features, 0.0), dict.fromkeys(features, 0.0)
    live = {f for f in facts if facts[f]["d"] and facts[f]["s"] and facts[f]["s"] > 0}
    for _ in range(steps):
        if not live:
            break
        terms = _newton_terms(_risk_sums(rows.where(F.col("feature").isin(*live)), beta, center), efron).collect()
        for r in terms:
            f, scale = r["feature"], facts[r["feature"]]["s"]
            info[f] = r["i"]
            step = r["u"] / r["i"] if r["i"] > 0 else 0.0
            beta[f] += math.copysign(min(abs(step), 2 / scale), step)
            if abs(step) * scale < 1e-9 or abs(beta[f]) * scale > 30:
                live.discard(f)
        live &= {r["feature"] for r in terms}
    c = {r["feature"]: r["cindex"] for r in concordance(df, duration, event, features).collect()}
    out = {}
    for f in features:
        se = 1 / math.sqrt(info[f]) if info[f] > 0 else float("nan")
        raw = c.get(f)
        raw = float("nan") if raw is None else raw
        out[f] = {"beta": beta[f], "hr": math.exp(min(beta[f], 700)), "se": se, "p": normal_two_sided(beta[f] / se) if se == se else float("nan"), "cindex": raw if beta[f] >= 0 else 1 - raw}
    return out


def count_pairs(t: np.ndarray, e: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(concordant, tied in x, comparable) pairs of weighted rows: an event at t against all that last longer, or that are
    censored at t. A Fenwick tree over x holds those that last longer."""
    levels, rank = np.unique(x, return_inverse=True)
    tree = [0.0] * (len(levels) + 1)
    held, equal = 0.0, [0.0] * len(levels)
    good = tie = pairs = 0.0
    order = np.lexsort((e, -t))  # longest first, the censored before the events of a time
    i, size = 0, len(levels)
    while i < len(order):
        j = i
        while j < len(order) and t[order[j]] == t[order[i]] and e[order[j]] == e[order[i]]:
            j += 1
        if e[order[i]] > 0:
            for k in order[i:j]:
                r, below = int(rank[k]), 0.0
                while r > 0:
                    below += tree[r]
                    r &= r - 1
                same = equal[int(rank[k])]
                good, tie, pairs = good + n[k] * below, tie + n[k] * same, pairs + n[k] * held
        for k in order[i:j]:
            r = int(rank[k]) + 1
            equal[r - 1] += n[k]
            held += n[k]
            while r <= size:
                tree[r] += n[k]
                r += r & -r
        i = j
    return good, tie, pairs


def concordance(df: DataFrame, duration: str, event: str, features: list[str]) -> DataFrame:
    """(feature, pairs, cindex): Harrell's C of each feature as a risk, higher meaning shorter. Rows are counted by
    (duration, event, x) first; a feature's distinct triples are one task."""
    c = _long(df, duration, event, features).withColumn("e", (F.col("e") > 0).cast("double")).groupBy("feature", "t", "e", "x").agg(F.count(F.lit(1)).alias("n"))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        good, tie, pairs = count_pairs(*(g[k].to_numpy(float) for k in ("t", "e", "x", "n")))
        return pd.DataFrame([[key[0], int(pairs), (good + tie / 2) / pairs if pairs else None]])

    return c.groupBy("feature").applyInPandas(one, "feature string, pairs long, cindex double")


def logrank_parts(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """(g, t, d, rg, ra, da) at each time with an event: deaths and rows at risk of the group, and of all."""
    rows = df.select(number(duration).alias("t"), (number(event) > 0).cast("long").alias("e"), F.col(group).cast("string").alias("g")).dropna()
    at = rows.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"))
    every = at.select("t").distinct().crossJoin(F.broadcast(at.select("g").distinct()))
    down = Window.partitionBy("g").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = every.join(at, ["g", "t"], "left").na.fill(0, ["n", "d"]).withColumn("r", F.sum("n").over(down))
    both = risk.withColumns({"ra": F.sum("r").over(Window.partitionBy("t")), "da": F.sum("d").over(Window.partitionBy("t"))}).where("da > 0")
    return both.select("g", "t", "d", F.col("r").cast("double").alias("rg"), F.col("ra").cast("double").alias("ra"), F.col("da").cast("double").alias("da"))


def logrank(df: DataFrame, duration: str, event: str, group: str) -> tuple[float, float]:
    """(statistic, p) of the test across all groups; only sums over event times, by group and pair of groups, reach the driver."""
    parts = keep(logrank_parts(df, duration, event, group))
    oe = parts.groupBy("g").agg(F.sum("d").alias("o"), F.sum(F.col("da") * F.col("rg") / F.col("ra")).alias("x")).orderBy("g").collect()
    names = [r["g"] for r in oe]
    if len(names) < 2:
        return (float("nan"),) * 2
    k = F.when(F.col("ra") > 1, F.col("da") * (F.col("ra") - F.col("da")) / (F.col("ra") - 1)).otherwise(0.0)
    a = parts.select("t", F.col("g").alias("a"), (F.col("rg") / F.col("ra")).alias("pa"), k.alias("k"))
    b = parts.select("t", F.col("g").alias("b"), (F.col("rg") / F.col("ra")).alias("pb"))
    v = np.zeros((len(names), len(names)))
    own = F.when(F.col("a") == F.col("b"), F.col("pa")).otherwise(0.0)
    for r in a.join(b, "t").groupBy("a", "b").agg(F.sum(F.col("k") * (own - F.col("pa") * F.col("pb"))).alias("v")).collect():
        v[names.index(r["a"]), names.index(r["b"])] = r["v"]
    z = np.array([r["o"] - r["x"] for r in oe])[:-1]
    statistic = float(z @ np.linalg.pinv(v[:-1, :-1]) @ z)
    return statistic, chi2_tail(statistic, len(names) - 1)

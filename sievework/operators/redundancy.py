"""Typed similarity of pairs of columns, groups of near-duplicate columns, representatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.thresholds import COLLAPSE
from .association import bergsma_v, eta_squared, spearman
from .profile import _text

NUMERIC = ("continuous", "count", "ordinal")


def _pairs_long(df: DataFrame, pairs: list[tuple[str, str]], numeric_a: bool, numeric_b: bool) -> DataFrame:
    """(a, b, x, y) for each row and pair; rows with a null in the pair are left out of that pair only."""
    pick = lambda c, num: number(f"`{c}`") if num else _text(df, c)
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pick(a, numeric_a).alias("x"), pick(b, numeric_b).alias("y")) for a, b in pairs])
    return df.select(F.explode(each).alias("p")).select("p.*").where("x is not null and y is not null")


def pairwise(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(a, b, score) with a < b by name: absolute Spearman of two numeric columns, corrected Cramér's V of two others, root of eta
    squared of one and one; 0 where undefined. String columns called ordinal have no numbers and score 0.
    Every pair is ranked over its own complete rows, so the work is rows times pairs: call it for the columns that are left."""
    names = sorted(types)
    num = {c: types[c] in NUMERIC for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    groups = {
        "nn": [(a, b) for a, b in pairs if num[a] and num[b]], "cc": [(a, b) for a, b in pairs if not num[a] and not num[b]],
        "cn": [(a, b) if not num[a] else (b, a) for a, b in pairs if num[a] != num[b]],
    }
    usable = lambda c: not num[c] or dict(df.dtypes)[c] != "string"
    groups = {k: [p for p in v if usable(p[0]) and usable(p[1])] for k, v in groups.items()}
    out = df.sparkSession.createDataFrame(pairs, "a string, b string")
    found = []
    if groups["nn"]:
        found.append(spearman(_pairs_long(df, groups["nn"], True, True), ["a", "b"]).select("a", "b", "effect"))
    if groups["cc"]:
        found.append(bergsma_v(_pairs_long(df, groups["cc"], False, False), ["a", "b"]).select("a", "b", "effect"))
    if groups["cn"]:
        found.append(eta_squared(_pairs_long(df, groups["cn"], False, True), ["a", "b"]).select("a", "b", F.sqrt("effect").alias("effect")))
    if not found:
        return out.withColumn("score", F.lit(0.0))
    scores = reduce(DataFrame.unionByName, [f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "effect") for f in found])
    return out.join(scores, ["a", "b"], "left").select("a", "b", F.coalesce(F.nanvl("effect", F.lit(0.0)), F.lit(0.0)).alias("score"))


def components(edges: DataFrame, threshold: float = COLLAPSE, score: str = "score") -> list[list[str]]:
    """Groups of two or more columns joined by pairs at or over the threshold, each sorted; columns are few, so this is on the driver."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        parent.setdefault(c, c)
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for r in edges.where(F.col(score) >= threshold).select("a", "b").collect():
        a, b = root(r["a"]), root(r["b"])
        parent[max(a, b)] = min(a, b)
    groups: dict[str, list[str]] = {}
    for c in parent:
        groups.setdefault(root(c), []).append(c)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def representative(group: list[str], effects: dict[str, float], missing: dict[str, float]) -> str:
    """The column with the greatest effect, then the fewest nulls, then the first name."""
    gaps = {c: missing.get(c, 0.0) for c in group}
    return min((-(effects.get(c) or 0.0), gaps[c], c) for c in group)[-1]

"""Connected components by alternating stars, in rounds of two small shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    Large star and small star alternate until the edge set stays the same; each round is written,
    so lineage stays short. The number of rounds grows with the logarithm of the largest component.
    """
    now = scratch.table(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct())
    mark = _mark(now)
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("r"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("r").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("r").alias("m")), F.struct("v", F.col("r").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        now = scratch.table(small)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first())

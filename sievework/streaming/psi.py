"""Population stability of a stream against a fixed reference, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket, number
from ..operators.drift import LEAST, bin_counts, quantile_edges


def windowed_counts(events: DataFrame, column: str, edges: list[float], ts: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, bin, n) of a stream (or a table): state is one row for each open window and bin. Rows later than the watermark are dropped."""
    x = events.select(F.col(ts).alias("ts"), number(column).alias("x")).where("x is not null and ts is not null")
    if events.isStreaming:
        x = x.withWatermark("ts", late)
    return x.groupBy(F.window("ts", window).alias("w"), bucket(F.col("x"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def psi_by_window(reference: DataFrame, counts: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(start, psi, n) from finished counts."""
    spark = reference.sparkSession
    bins = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    ref = bins.join(bin_counts(reference, column, edges, "e"), "bin", "left").na.fill(0, ["e"])
    total = ref.agg(F.sum("e")).first()[0] or 0
    grid = counts.select("start").distinct().crossJoin(F.broadcast(ref))
    both = grid.join(counts, ["start", "bin"], "left").na.fill(0, ["n"])
    size = counts.groupBy("start").agg(F.sum("n").alias("t"))
    e = F.greatest(F.col("e") / F.lit(float(max(total, 1))), F.lit(LEAST))
    a = F.greatest(F.col("n") / F.col("t"), F.lit(LEAST))
    return both.join(size, "start").groupBy("start").agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.sum("n").alias("n"))


def watch(stream: DataFrame, reference: DataFrame, column: str, ts: str, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour", bins: int = 10):
    """Start a query that appends (start, psi, n) of each finished window to Parquet at path."""
    edges = quantile_edges(reference, column, bins)

    def each(batch: DataFrame, number_: int) -> None:
        psi_by_window(reference, batch, column, edges).write.mode("append").parquet(path)

    counts = windowed_counts(stream, column, edges, ts, window, late)
    return counts.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

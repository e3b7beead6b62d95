"""Written tables that cut lineage, in the folder that the session names in spark.checkpoint.dir; small files on any file system that Spark can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where the setting is missing, a temporary folder is set for a session on one machine, and anything else is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df written and read again; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """df, read from a written table, with a broadcast hint if its files hold at most BROADCAST_BYTES; else df, which is then joined by a shuffle."""
    return F.broadcast(df) if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES else df


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so a reader never sees half of it."""
    part, fs = _path(spark, path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    done, _ = _path(spark, path)
    fs.delete(done, False)
    fs.rename(part, done)

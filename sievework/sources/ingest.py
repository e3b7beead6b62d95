"""Reading one table, and making its columns fit for screening."""

from __future__ import annotations

import importlib
import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PANDAS = {".xlsx": "read_excel", ".xls": "read_excel", ".dta": "read_stata", ".sav": "read_spss", ".sas7bdat": "read_sas"}


def _encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless a line doesn't decode; then the one-byte code in which every byte does."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the lower-cased suffix: Parquet and ORC, JSON lines, files of statistics programs (through pandas
    on the driver, where its reader is installed), and CSV for every other suffix. Tab files (.tsv) are split on tabs."""
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix in (".parquet", ".pq"):
        return spark.read.options(**options).parquet(str(path))
    if suffix == ".orc":
        return spark.read.options(**options).orc(str(path))
    if suffix in (".json", ".jsonl"):
        return spark.read.options(**options).json(str(path))
    if suffix in _PANDAS:
        try:
            frame = getattr(importlib.import_module("pandas"), _PANDAS[suffix])(os.fspath(path))
        except ImportError as e:
            raise ImportError(f"reading {suffix} files needs a library that is not installed: {e}") from e
        return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).convert_dtypes())
    how = {"header": True, "inferSchema": True, "sep": "\t" if suffix == ".tsv" else ","} | options
    if "encoding" not in how:
        how["encoding"] = _encoding(spark, str(path))
    return spark.read.options(**how).csv(str(path))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null, decimals doubles; other columns as they are."""
    changed = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            changed[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = c.cast("double")
    return df.withColumns(changed) if changed else df


def with_row_key(df: DataFrame, key: str | None = None, name: str = "row_key") -> DataFrame:
    """df with a key that doesn't depend on partitioning: the column key if given (ValueError if it has nulls or a value twice: folds are joined on it), else the MD5 of all columns and, for
    rows that are equal in all of them, a number."""
    if key is not None:
        bad = df.groupBy(F.col(key)).count().where(F.col("count") > 1).limit(1).count() or df.where(F.col(key).isNull()).limit(1).count()
        if bad:
            raise ValueError(f"{key!r} is no row key: it has nulls or a value more than once")
        return df.withColumn(name, F.col(key).cast("string"))
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    turn = F.row_number().over(Window.partitionBy("__digest").orderBy(F.lit(1)))
    return df.withColumn("__digest", digest).withColumn(name, F.concat_ws("-", "__digest", turn)).drop("__digest")

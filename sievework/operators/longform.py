"""The long form of a table: one row for each row and feature, reduced early to counted cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number
from .profile import _text


def numeric(df: DataFrame, features: list[str], y: Column, extra: list[str] = ()) -> DataFrame:
    """(extra, feature, x double, y) of rows in which both are given. Only the named columns are read."""
    wide = df.select(*extra, y.alias("y"), *[number(f"`{f}`").alias(f) for f in features])
    return wide.unpivot([*extra, "y"], features, "feature", "x").where("x is not null and y is not null")


def categorical(df: DataFrame, features: list[str], y: Column, extra: list[str] = (), nulls: bool = False) -> DataFrame:
    """The same with x as a string; nulls keeps rows whose x is null."""
    wide = df.select(*extra, y.alias("y"), *[_text(df, f).alias(f) for f in features])
    long = wide.unpivot([*extra, "y"], features, "feature", "x")
    return long.where("y is not null" if nulls else "x is not null and y is not null")


def cells(long: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Rows counted by group and value, combined before the shuffle."""
    return long.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))

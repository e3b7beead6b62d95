"""Column expressions: datetime derivation, hurdle split, sentinels, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL_NUMBERS = (-9999, -999, -99, 9999, 99999, 999999)
SENTINEL_TOKENS = ("", *". - -- ? missing n/a na nan none null unknown".split())


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.BooleanType)


def number(c: Column | str) -> Column:
    """As double, NaN as null."""
    c = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(~F.isnan(c), c)


def derive_datetime(df: DataFrame, column: str, reference=None) -> DataFrame:
    """df with 14 columns `column`__year and so on. Null where the timestamp is null, but is_weekend is
    then 0; recency is counted from reference, or from the latest value of the column (one extra aggregate)."""
    ts = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        ts = F.try_to_timestamp(ts)
    ts = ts.cast("timestamp_ntz")
    if reference is None:
        df = df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("__ref"))))
        ref = F.col("__ref")
    else:
        ref = F.lit(reference).cast("timestamp_ntz")
    days = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(86_400e6)
    month, dow, hour = F.month(ts), F.weekday(ts), F.hour(ts)
    turn = lambda v, period: F.lit(2.0) * F.pi() * v / F.lit(float(period))
    parts = {
        "year": F.year(ts), "month": month, "dow": dow, "day": F.day(ts), "hour": hour,
        "is_weekend": F.when(dow >= 5, 1.0).otherwise(0.0), "days_since_epoch": days(ts), "recency_days": days(ref) - days(ts),
    }
    for name, v, period in (("month", month, 12), ("dow", dow, 7), ("hour", hour, 24)):
        parts |= {f"{name}_sin": F.sin(turn(v, period)), f"{name}_cos": F.cos(turn(v, period))}
    return df.withColumns({f"{column}__{k}": v for k, v in parts.items()}).drop("__ref")


def hurdle_split(c: Column) -> tuple[Column, Column]:
    """(is zero as 0.0 or 1.0, null counting as not zero; the positive values, else null)."""
    return F.when(c == 0, 1.0).otherwise(0.0), F.when(c > 0, c)


def null_sentinels(df: DataFrame, found: dict[str, list], trim: bool = False) -> DataFrame:
    """df with the listed values of each column as null. trim compares strings trimmed and lower-cased."""
    def clean(c: str) -> Column:
        x = F.lower(F.trim(F.col(c))) if trim and isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
        return F.when(~F.coalesce(x.isin(found[c]), F.lit(False)), F.col(c))

    return df.withColumns({c: clean(c) for c in found if c in df.columns})


def bucket(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [e_i, e_i+1) of x under ascending inner edges."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) if edges else F.lit(0)

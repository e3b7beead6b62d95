"""Facts on the columns of one table: counts, structure, types, missing values, sentinels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SENTINEL_NUMBERS, SENTINEL_TOKENS, is_number, number
from ..functions.thresholds import NEAR_CONSTANT, NEAR_EMPTY

TARGET_HINTS = tuple("churn class default fraud label outcome target y".split())
DATE_HINTS = tuple("date datetime dt time timestamp".split())


def _text(df: DataFrame, c: str) -> Column:
    """A string that is equal exactly where the values are; -0.0 is 0.0 and NaN is null."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DoubleType | T.FloatType):
        x = F.col(f"`{c}`")
        return F.when(~F.isnan(x), x + F.lit(0.0)).cast("string")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(F.col(f"`{c}`"))
    return F.col(f"`{c}`").cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, value as string, n), nulls as a value; counts are combined before the shuffle."""
    columns = columns or df.columns
    return df.select(*[_text(df, c).alias(c) for c in columns]).unpivot([], columns, "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _kinds(df: DataFrame) -> Column:
    """feature -> declared type."""
    return F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, n, n_unique, missing_rate, top_share, all_unique), rates at 4 places; top_share is over rows with a value."""
    has = F.col("value").isNotNull()
    facts = value_counts(df, columns).groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("present"), F.coalesce(F.max(F.when(has, F.col("n"))), F.lit(0)).alias("top")
    )
    rate = F.round(1 - F.col("present") / F.col("n"), 4)
    share = F.when(F.col("present") > 0, F.round(F.col("top") / F.col("present"), 4)).otherwise(0.0)
    return facts.select(F.col("feature").alias("column"), _kinds(df)[F.col("feature")].alias("dtype"), "n", "n_unique", rate.alias("missing_rate"), share.alias("top_share"), (F.col("n_unique") == F.col("n")).alias("all_unique"))


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, values): the k least distinct values as strings."""
    return value_counts(df, columns).where("value is not null").groupBy(F.col("feature").alias("column")).agg(F.expr(f"slice(array_sort(collect_set(value)), 1, {k})").alias("values"))


def structural_flags(facts: DataFrame, protected: list[str] = (), duplicates: dict[str, str] | None = None) -> DataFrame:
    """(column, flag) of a profile; the first rule that fits, null if none does or the column is protected."""
    c = F.col("column")
    same = c.isin(list(duplicates)) if duplicates else F.lit(False)
    rule = (
        F.when(c.isin(list(protected)), F.lit(None)).when(F.col("n_unique") <= 1, "constant").when(F.col("top_share") > NEAR_CONSTANT, "near_constant").when(F.col("missing_rate") > NEAR_EMPTY, "near_empty")
        .when(F.col("all_unique") & ~F.col("dtype").isin("double", "float"), "identifier").when(same, "duplicate")
    )
    return facts.select("column", rule.cast("string").alias("flag"))


_INTEGER = ("tinyint", "smallint", "int", "bigint")
_REAL = ("double", "float")


def semantic_types(facts: DataFrame) -> DataFrame:
    """(column, semantic_type): constant and identifier besides the feature types; never ordinal, which is for a person to say."""
    u, kind = F.col("n_unique"), F.col("dtype")
    integer, real = kind.isin(*_INTEGER), kind.isin(*_REAL)
    rule = (
        F.when(u <= 1, "constant").when(kind.isin("date", "timestamp", "timestamp_ntz"), "datetime").when(kind == "boolean", "binary")
        .when((integer | real) & (u == 2), "binary").when(integer & F.col("all_unique"), "identifier").when(integer & (u <= 15), "nominal").when(integer, "count").when(real, "continuous")
        .when(F.col("all_unique"), "identifier").when(u > 50, "high_card").otherwise("nominal")
    )
    return facts.select("column", rule.alias("semantic_type"))


def target_types(facts: DataFrame) -> DataFrame:
    """(column, target_type) as a suggestion; never ordinal or survival."""
    u, kind = F.col("n_unique"), F.col("dtype")
    rule = F.when(u <= 1, "unknown").when(u == 2, "binary").when(kind.isin(*_INTEGER) & (u <= 15), "multiclass").when(kind.isin(*_INTEGER, *_REAL), "regression").otherwise("multiclass")
    return facts.select("column", rule.alias("target_type"))


def target_facts(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """(value, n, n_unique, n_nulls) of the top values of a target, the greatest count first."""
    counts = value_counts(df, [target])
    facts = counts.agg(F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"))
    return counts.where("value is not null").orderBy(F.col("n").desc(), "value").limit(top).select("value", "n").crossJoin(F.broadcast(facts))


def target_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in TARGET_HINTS]


def looks_like_dates(df: DataFrame, columns: list[str] | None = None, sample: int = 50, share: float = 0.8) -> list[str]:
    """Columns of a date type, and string columns of whose first values at least share can be read as a timestamp."""
    columns = columns or df.columns
    out = [c for c in columns if isinstance(df.schema[c].dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]
    for c in columns:
        if isinstance(df.schema[c].dataType, T.StringType):
            some = df.where(F.col(c).isNotNull()).select(c).limit(sample)
            if (some.agg(F.avg(F.try_to_timestamp(F.col(c)).isNotNull().cast("double"))).first()[0] or 0) >= share:
                out.append(c)
    return out


def date_candidates(df: DataFrame) -> list[str]:
    """Date-like columns, those with a telling name first."""
    found = looks_like_dates(df)
    named = [c for c in found if any(h in c.lower() for h in DATE_HINTS)]
    return named + [c for c in df.columns if c in found and c not in named]


def id_candidates(facts: DataFrame) -> DataFrame:
    """(column) named like an id, or with as many values as rows."""
    name = F.lower("column")
    return facts.where((name == "id") | name.endswith("_id") | (F.col("n_unique") == F.col("n"))).select("column")


def grain(df: DataFrame, ids: list[str]) -> DataFrame:
    """(column, repeats): does a value occur twice; nulls are equal to each other."""
    return value_counts(df, ids).groupBy(F.col("feature").alias("column")).agg((F.max("n") > 1).alias("repeats"))


def viability(df: DataFrame, target: str, target_type: str, event: str | None = None) -> DataFrame:
    """One row (positives, effective_n, prevalence, censoring, target_nulls)."""
    nulls, n = F.count_if(F.col(target).isNull()), F.count(F.lit(1))
    none = F.lit(None).cast("double")
    if target_type in ("binary", "multiclass", "ordinal"):
        per = value_counts(df, [target])
        has = F.when(F.col("value").isNotNull(), F.col("n"))
        least = F.coalesce(F.min(has), F.lit(0))
        return per.agg(least.alias("positives"), least.alias("effective_n"), F.round(F.min(has) / F.sum(has), 4).alias("prevalence"), none.alias("censoring"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("target_nulls"))
    if target_type == "survival" and event is not None:
        events = F.coalesce(F.sum(F.coalesce(number(event), F.lit(0.0))), F.lit(0.0)).cast("long")
        return df.agg(events.alias("positives"), events.alias("effective_n"), none.alias("prevalence"), F.round(1 - events / F.nullif(n, F.lit(0)), 4).alias("censoring"), nulls.alias("target_nulls"))
    return df.agg(F.lit(None).cast("long").alias("positives"), F.count(target).alias("effective_n"), none.alias("prevalence"), none.alias("censoring"), nulls.alias("target_nulls"))


def duplicate_columns(df: DataFrame) -> dict[str, str]:
    """column -> first column of the same type with the same values (null equal to null). Sums of hashes, bound to
    the row, find the candidates in one pass; a second pass over these alone compares values."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])

    def print_of(c: str) -> list[Column]:
        h = F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")), row)
        return [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << 21) - 1))).alias(f"{c}:{s}") for s in (0, 21, 42)]

    sums = df.agg(*[x for c in df.columns for x in print_of(c)]).first()
    first, asked = {}, []
    for c in df.columns:
        key = (df.schema[c].dataType.simpleString(), *[sums[f"{c}:{s}"] for s in (0, 21, 42)])
        if key in first:
            asked.append((first[key], c))
        first.setdefault(key, c)
    if not asked:
        return {}
    same = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))), F.lit(True)) for a, b in asked]).first()
    return {b: a for (a, b), ok in zip(asked, same, strict=True) if ok}


def sentinel_candidates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, sentinel, n): values that often stand for a missing one. Strings are compared trimmed and lower-cased."""
    columns = columns or df.columns
    numeric = [c for c in columns if is_number(df.schema[c].dataType)]
    strings = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    out = []
    if numeric:
        x = df.select(*[number(c).alias(c) for c in numeric]).unpivot([], numeric, "column", "x")
        out.append(x.where(F.col("x").isin(*[float(s) for s in SENTINEL_NUMBERS])).groupBy("column", F.col("x").cast("long").cast("string").alias("sentinel")).agg(F.count(F.lit(1)).alias("n")))
    if strings:
        x = df.select(*strings).unpivot([], strings, "column", "x").select("column", F.lower(F.trim("x")).alias("x"))
        out.append(x.where(F.col("x").isin(*SENTINEL_TOKENS)).groupBy("column", F.concat(F.lit("'"), "x", F.lit("'")).alias("sentinel")).agg(F.count(F.lit(1)).alias("n")))
    if not out:
        return df.sparkSession.createDataFrame([], "column string, sentinel string, n long")
    return reduce(DataFrame.unionByName, out)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, mean, skew, zero_frac, flags) of numeric columns at 4 places. skew is the adjusted sample skewness,
    0 for two values or fewer and for constants."""
    x = df.select(*[number(c).alias(c) for c in columns]).unpivot([], columns, "column", "x").where("x is not null")
    g = x.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.skewness("x").alias("g1"), F.avg((F.col("x") == 0).cast("double")).alias("z"), F.count("x").alias("n"))
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") <= 2) | (F.col("lo") == F.col("hi")), 0.0).otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    r = lambda c: F.round(c, 4)
    flags = F.concat_ws(";", F.when(F.col("z") > 0.5, "zero-inflated"), F.when(F.abs(F.col("s")) > 2, "skewed"))
    return g.withColumn("s", skew).select("column", r("lo").alias("min"), r("hi").alias("max"), r("m").alias("mean"), r("s").alias("skew"), r("z").alias("zero_frac"), flags.alias("flags"))


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing): the share of nulls and NaN at 4 places, from one pass without a shuffle of rows."""
    gone = [F.round(F.avg(_text(df, c).isNull().cast("double")), 4).alias(c) for c in df.columns]
    return df.agg(*gone).unpivot([], df.columns, "column", "missing")


def comissing_pairs(df: DataFrame) -> DataFrame:
    """(a, b, corr) of the null masks of columns that are sometimes null. Rows are first counted by their set of
    null columns, so pairs are formed from patterns and not from rows."""
    null = F.filter(F.array(*[F.when(_text(df, c).isNull(), F.lit(c)) for c in df.columns]), lambda x: x.isNotNull())
    patterns = df.select(null.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    total = patterns.agg(F.sum("n").cast("double").alias("total"))
    alone = patterns.select(F.explode("s").alias("c"), "n").groupBy("c").agg(F.sum("n").cast("double").alias("k")).crossJoin(F.broadcast(total)).where("k < total")
    pairs = patterns.select(F.explode("s").alias("a"), "s", "n").select("a", F.explode("s").alias("b"), "n").where("a < b").groupBy("a", "b").agg(F.sum("n").cast("double").alias("both"))
    every = alone.select(F.col("c").alias("a"), F.col("k").alias("ka"), "total").join(F.broadcast(alone.select(F.col("c").alias("b"), F.col("k").alias("kb"))), F.col("a") < F.col("b"))
    joined = every.join(pairs, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0.0)))
    corr = (F.col("total") * F.col("both") - F.col("ka") * F.col("kb")) / F.sqrt(F.col("ka") * (F.col("total") - F.col("ka")) * F.col("kb") * (F.col("total") - F.col("kb")))
    return joined.select("a", "b", corr.alias("corr"))


def nulls_by_class(df: DataFrame, y: Column, columns: list[str]) -> DataFrame:
    """(column, p1, p0, n1, n0): shares of nulls in rows with y = 1 and y = 0."""
    marked = df.select(y.alias("__y"), *[_text(df, c).isNull().cast("double").alias(c) for c in columns]).where("__y is not null")
    per = marked.groupBy("__y").agg(F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(["__y", "__n"], columns, "column", "p")
    pick = lambda c, k: F.max(F.when(F.col("__y") == k, F.col(c)))
    return per.groupBy("column").agg(pick("p", 1).alias("p1"), pick("p", 0).alias("p0"), pick("__n", 1).alias("n1"), pick("__n", 0).alias("n0"))


def missingness_auc(df: DataFrame, y: Column, columns: list[str]) -> DataFrame:
    """(column, auc): how well being null tells the classes apart, in closed form; null for a constant mask."""
    auc = F.when((F.col("p1") != F.col("p0")) | F.col("p1").between(1e-300, 1 - 1e-16), 0.5 + 0.5 * F.abs(F.col("p1") - F.col("p0")))
    return nulls_by_class(df, y, columns).select("column", auc.alias("auc"))


def one_class_presence(df: DataFrame, y: Column, columns: list[str]) -> DataFrame:
    """(column, present1, present0) of columns that are present in one class (over half) and all but absent (under 2 %) in the other."""
    shares = nulls_by_class(df, y, columns).select("column", (1 - F.coalesce("p1", F.lit(1.0))).alias("present1"), (1 - F.coalesce("p0", F.lit(1.0))).alias("present0"))
    a, b = F.col("present1"), F.col("present0")
    return shares.where(((a > 0.5) & (b < 0.02)) | ((b > 0.5) & (a < 0.02)))


def binary01(df: DataFrame, target: str) -> Column:
    """The target as 0 and 1, its two values in ascending order; ValueError for any other number of values."""
    x = F.col(f"`{target}`")
    if isinstance(df.schema[target].dataType, T.DoubleType | T.FloatType):
        x = F.when(~F.isnan(x), x)
    found = sorted(r[0] for r in df.select(x.alias("v")).where("v is not null").distinct().limit(1000).collect())
    if len(found) != 2:
        raise ValueError(f"{target} has {len(found)} classes; a binary target has 2")
    return F.when(x == F.lit(found[1]), 1).when(x == F.lit(found[0]), 0)

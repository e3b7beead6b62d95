"""Named queries over the test tables, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import thresholds as H
from .operators import association as A
from .operators import crosscheck as X
from .operators import drift as D
from .operators import folds as E
from .operators import information as I
from .operators import leakage as L
from .operators import profile as P
from .operators import redundancy as R
from .operators import report as O
from .operators import resampling as S
from .operators import survival as V
from .operators.longform import categorical, numeric
from .plans import relevance as RL
from .plans.run import open_run
from .sources.scratch import keep, shared_folder
from .streaming import psi as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Floating results rounded, -0.0 as 0.0."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


# profile

_COLUMNS = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
}


def _facts_sql(table: str) -> str:
    parts = " union all ".join(f"select '{c}' as \"column\", '{k}' as dtype, sum(n) n, count(v) n_unique, sum(case when v is not null then n else 0 end) present, coalesce(max(case when v is not null then n end), 0) top from (select {c} v, count(*) n from {table} group by {c})" for c, k in _COLUMNS[table].items())
    return f'select "column", dtype, cast(n as bigint) n, cast(n_unique as bigint) n_unique, round(1 - present / n, 4) missing_rate, case when present > 0 then round(top / present, 4) else 0.0 end top_share, n_unique = n all_unique from ({parts})'


@query(_facts_sql("orders"))
def profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(_t(spark, sf, "orders"))


@query(_facts_sql("part"))
def profile_part(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(_t(spark, sf, "part"))


@query(_facts_sql("lineitem"))
def profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(_t(spark, sf, "lineitem"))


_FLAG = "case when n_unique <= 1 then 'constant' when top_share > 0.98 then 'near_constant' when missing_rate > 0.95 then 'near_empty' when all_unique and dtype not in ('double', 'float') then 'identifier' end"


@query(f'select "column", {_FLAG} flag from ({_facts_sql("customer")})')
def structural_flags_customer(spark: SparkSession, sf: str) -> DataFrame:
    return P.structural_flags(P.profile(_t(spark, sf, "customer")))


_SEMANTIC = """case when n_unique <= 1 then 'constant' when dtype like 'timestamp%' then 'datetime' when dtype in ('int', 'bigint', 'double') and n_unique = 2 then 'binary'
  when dtype in ('int', 'bigint') then case when all_unique then 'identifier' when n_unique <= 15 then 'nominal' else 'count' end when dtype = 'double' then 'continuous' when all_unique then 'identifier' when n_unique > 50 then 'high_card' else 'nominal' end"""


@query(f'select "column", {_SEMANTIC} semantic_type from ({_facts_sql("lineitem")})')
def semantic_types_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return P.semantic_types(P.profile(_t(spark, sf, "lineitem")))


@query(f"select \"column\", case when n_unique <= 1 then 'unknown' when n_unique = 2 then 'binary' when dtype in ('int', 'bigint') and n_unique <= 15 then 'multiclass' when dtype in ('int', 'bigint', 'double') then 'regression' else 'multiclass' end target_type from ({_facts_sql('part')})")
def target_types_part(spark: SparkSession, sf: str) -> DataFrame:
    return P.target_types(P.profile(_t(spark, sf, "part")))


@query("select event_type as value, count(*) n, cast((select count(distinct event_type) from events) as bigint) n_unique, cast(0 as bigint) n_nulls from events group by event_type order by n desc, value limit 10")
def target_facts_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.target_facts(_t(spark, sf, "events"), "event_type")


@query("select min(n) positives, min(n) effective_n, round(min(n) / sum(n), 4) prevalence, cast(null as double) censoring, cast(0 as bigint) target_nulls from (select count(*) n from orders group by o_orderstatus)")
def viability_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.viability(_t(spark, sf, "orders"), "o_orderstatus", "multiclass")


@query(f'select "column" from ({_facts_sql("orders")}) where n_unique = n')
def id_candidates_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.id_candidates(P.profile(_t(spark, sf, "orders")))


@query("select 'l_orderkey' as \"column\", count(*) > count(distinct l_orderkey) repeats from lineitem union all select 'l_partkey', count(*) > count(distinct l_partkey) from lineitem")
def grain_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return P.grain(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("select 'p_name' as \"column\", list_sort(list_distinct(list(p_name)))[1:5] \"values\" from part union all select 'p_brand', list_sort(list_distinct(list(p_brand)))[1:5] from part")
def sample_values_part(spark: SparkSession, sf: str) -> DataFrame:
    return P.sample_values(_t(spark, sf, "part"), ["p_name", "p_brand"])


# values

_SENT = "select event_id, case when event_id % 50 = 0 then -999 else value end v, case when event_id % 40 = 0 then ' N/A' else event_type end e from events"


def _sentinel_events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", F.expr("case when event_id % 50 = 0 then -999 else value end").alias("v"), F.expr("case when event_id % 40 = 0 then ' N/A' else event_type end").alias("e"))


@query(f"with t as ({_SENT}) select 'v' as \"column\", cast(cast(v as bigint) as varchar) sentinel, count(*) n from t where v in (-9999, -999, -99, 9999, 99999, 999999) group by v union all select 'e', '''' || lower(trim(e)) || '''', count(*) from t where lower(trim(e)) in ('', '-', '?', '.', 'na', 'n/a', 'nan', 'null', 'none', '--', 'unknown', 'missing') group by lower(trim(e))")
def sentinels_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.sentinel_candidates(_sentinel_events(spark, sf).select("v", "e"))


@query(f"with t as ({_SENT}) select event_id, case when v <> -999 then v end v, case when lower(trim(e)) <> 'n/a' then e end e from t")
def null_sentinels_events(spark: SparkSession, sf: str) -> DataFrame:
    return C.null_sentinels(_sentinel_events(spark, sf), {"v": [-999.0], "e": ["n/a"]}, trim=True)


def _dist_sql(table: str, *cols: str) -> str:
    one = " union all ".join(f"select '{c}' as \"column\", min({c}) a, max({c}) b, avg({c}) m, case when min({c}) = max({c}) then 0 else skewness({c}) end s, avg(case when {c} = 0 then 1.0 else 0.0 end) z from {table}" for c in cols)
    return f"select \"column\", round(a, 4) \"min\", round(b, 4) \"max\", round(m, 4) mean, round(s, 4) skew, round(z, 4) zero_frac, concat_ws(';', case when z > 0.5 then 'zero-inflated' end, case when abs(s) > 2 then 'skewed' end) flags from ({one})"


@query(_dist_sql("events", "value"))
def distribution_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.distribution(_t(spark, sf, "events"), ["value"])


@query(_dist_sql("lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def distribution_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return P.distribution(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_GAPS = "select case when event_type = 'purchase' then 1 else 0 end y, case when event_id % 7 = 0 then null else value end a, case when event_id % 7 = 0 or event_id % 91 = 0 then null else user_id end b, case when event_type = 'purchase' then null else event_type end c, case when event_type = 'purchase' and event_id % 3 <> 0 then value end d, case when event_id % 7 = 0 then null else ts end e from events"


def _gap_events(spark: SparkSession, sf: str) -> DataFrame:
    _t(spark, sf, "events").createOrReplaceTempView("__gap_source")
    out = spark.sql(_GAPS.replace("from events", "from __gap_source"))
    return out


@query(f"with t as ({_GAPS}) unpivot (select round(avg(case when y is null then 1.0 else 0 end), 4) y, " + ", ".join(f"round(avg(case when {c} is null then 1.0 else 0 end), 4) {c}" for c in "abcde") + ' from t) on y, a, b, c, d, e into name "column" value missing')
def missingness_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.missingness(_gap_events(spark, sf))


@query(f"with t as ({_GAPS}) " + " union all ".join(f"select '{a}' a, '{b}' b, round(corr(case when {a} is null then 1 else 0 end, case when {b} is null then 1 else 0 end), 6) + 0.0 corr from t" for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]))
def comissing_events(spark: SparkSession, sf: str) -> DataFrame:
    return _r(P.comissing_pairs(_gap_events(spark, sf)), "corr")


@query(f"with t as ({_GAPS}) " + " union all ".join(f"select '{c}' as \"column\", round(0.5 + 0.5 * abs(avg(case when y = 1 then case when {c} is null then 1.0 else 0 end end) - avg(case when y = 0 then case when {c} is null then 1.0 else 0 end end)), 6) auc from t" for c in "abcde"))
def missingness_auc_events(spark: SparkSession, sf: str) -> DataFrame:
    return _r(P.missingness_auc(_gap_events(spark, sf), F.col("y"), list("abcde")), "auc")


@query(f"with t as ({_GAPS}), s as (" + " union all ".join(f"select '{c}' as \"column\", avg(case when y = 1 then case when {c} is null then 0.0 else 1 end end) p1, avg(case when y = 0 then case when {c} is null then 0.0 else 1 end end) p0 from t" for c in "abcde") + ') select "column", round(p1, 6) present1, round(p0, 6) present0 from s where (p1 > 0.5 and p0 < 0.02) or (p0 > 0.5 and p1 < 0.02)')
def one_class_presence_events(spark: SparkSession, sf: str) -> DataFrame:
    return _r(P.one_class_presence(_gap_events(spark, sf), F.col("y"), list("abcde")), "present1", "present0")


_DUP = "with t as (select *, c_acctbal copy, c_mktsegment || '' again, case when c_custkey > 1 then c_acctbal end near from customer) select \"column\", first_column from ("


@query(_DUP + " union all ".join(f"select '{b}' as \"column\", '{a}' first_column, bool_and({a} is not distinct from {b}) ok from t" for a, b in (("c_acctbal", "copy"), ("c_acctbal", "near"), ("copy", "near"), ("c_name", "c_mktsegment"), ("c_name", "again"), ("c_mktsegment", "again"))) + ") where ok")
def duplicate_columns_customer(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").withColumn("copy", F.col("c_acctbal")).withColumn("again", F.concat("c_mktsegment", F.lit(""))).withColumn("near", F.when(F.col("c_custkey") > 1, F.col("c_acctbal")))
    return spark.createDataFrame(list(P.duplicate_columns(df).items()), "`column` string, first_column string")


_HOURS = "epoch_us(cast(o_orderdate as timestamp)) / 86400e6"
_DT = {
    "year": "year(d)", "month": "month(d)", "dow": "isodow(d) - 1", "day": "day(d)", "hour": "hour(d)", "is_weekend": "case when isodow(d) >= 6 then 1.0 else 0.0 end", "days_since_epoch": "epoch_us(d) / 86400e6", "recency_days": "(max(epoch_us(d)) over () - epoch_us(d)) / 86400e6",
    "month_sin": "sin(2 * pi() * month(d) / 12)", "month_cos": "cos(2 * pi() * month(d) / 12)", "dow_sin": "sin(2 * pi() * (isodow(d) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(d) - 1) / 7)", "hour_sin": "sin(2 * pi() * hour(d) / 24)", "hour_cos": "cos(2 * pi() * hour(d) / 24)",
}


@query("select o_orderkey, " + ", ".join(f"cast({v} as int) d__{k}" if k in ("year", "month", "dow", "day", "hour") else f"round({v}, 6) + 0.0 d__{k}" for k, v in _DT.items()) + " from (select o_orderkey, cast(o_orderdate as timestamp) d from orders)")
def datetime_parts_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = C.derive_datetime(_t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")
    return _r(df, *[f"d__{k}" for k in _DT if k not in ("year", "month", "dow", "day", "hour")])


@query("select l_linenumber, round(avg(case when l_tax = 0 then 1.0 else 0 end), 6) zeros, round(avg(case when l_tax > 0 then l_tax end), 6) positive from lineitem group by l_linenumber")
def hurdle_split_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    zero, rest = C.hurdle_split(F.col("l_tax"))
    return _r(_t(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg(zero).alias("zeros"), F.avg(rest).alias("positive")), "zeros", "positive")


# folds


@query("select event_id row_key, cast((row_number() over (partition by event_type order by md5('42|' || event_id), event_id) - 1) % 5 + 1 as int) fold from events")
def folds_stratified_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.make_folds(_t(spark, sf, "events"), "stratified", key="event_id", target="event_type").frame


@query("with t as (select o_orderkey row_key, row_number() over (order by o_orderdate, o_orderkey) - 1 rn, count(*) over () n from orders), s as (select row_key, rn, n // 6 test, n - 5 * (n // 6) first from t) select row_key, cast(case when rn < first then 0 else (rn - first) // test + 1 end as int) fold from s")
def folds_time_orders(spark: SparkSession, sf: str) -> DataFrame:
    return E.make_folds(_t(spark, sf, "orders"), "time", key="o_orderkey", date="o_orderdate").frame


@query("select p_partkey row_key, cast((row_number() over (order by md5('42|' || p_partkey), p_partkey) - 1) % 4 + 1 as int) fold from part")
def folds_plain_part(spark: SparkSession, sf: str) -> DataFrame:
    return E.make_folds(_t(spark, sf, "part"), "plain", 4, key="p_partkey").frame


@query()
def folds_grouped_orders(spark: SparkSession, sf: str) -> DataFrame:
    return E.make_folds(_t(spark, sf, "orders"), "grouped", key="o_orderkey", group="o_custkey").frame


@query("with recursive g as (select n, row_number() over (order by n desc, c) i from (select o_custkey c, count(*) n from orders group by 1)), d as (select cast(0 as bigint) i, [cast(0 as bigint), 0, 0, 0, 0] l union all select g.i, list_transform(l, lambda v, j: case when j = list_position(l, list_min(l)) then v + g.n else v end) from d join g on g.i = d.i + 1) select n, cast(count(*) as bigint) folds from (select unnest(l) n from d where i = (select max(i) from g)) group by n")
def fold_loads_grouped_orders(spark: SparkSession, sf: str) -> DataFrame:
    """How many folds have how many rows, if groups go one by one to the fold with the fewest."""
    f = E.make_folds(_t(spark, sf, "orders"), "grouped", key="o_orderkey", group="o_custkey").frame
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("folds"))


_STRAT = "select {key} k, cast((row_number() over (partition by {c} order by md5('42|' || {key}), {key}) - 1) % 5 + 1 as int) fold from {t}"


@query("with f as (" + _STRAT.format(key="o_orderkey", c="o_orderstatus", t="orders") + "), r as (select o_orderstatus s from orders group by 1 order by count(*), 1 limit 1) select fold, cast(count_if(o_orderstatus = s) as bigint) positives from orders join f on k = o_orderkey, r group by fold")
def fold_positives_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return E.fold_positives(o, E.make_folds(o, "stratified", key="o_orderkey", target="o_orderstatus"), "o_orderstatus", key="o_orderkey")


# association


def _auc_sql(table: str, features: list[str], y: str, extra: str = "", by: str = "") -> str:
    rows = " union all ".join(f"select '{f}' feature, cast({f} as double) x, {y} y {extra} from {table}" for f in features)
    return f"select feature{by}, n, round(greatest(a, 1 - a), 6) effect from (select feature{by}, count(*) n, (sum(r2 * y) / 2.0 - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) a from (select feature{by}, y, 2 * rank() over (partition by feature{by} order by x) + count(*) over (partition by feature{by}, x) - 1 r2 from ({rows})) group by feature{by})"


_F01 = "case when o_orderstatus = 'F' then 1 else 0 end"


@query(_auc_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], _F01))
def auc_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.auc(numeric(_t(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], F.expr(_F01)), ["feature"]), "effect")


@query("with f as (" + _STRAT.format(key="o_orderkey", c="o_orderstatus", t="orders") + ") " + _auc_sql("orders join f on k = o_orderkey", ["o_custkey", "o_totalprice"], _F01, ", fold", ", fold"))
def auc_by_fold_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    f = E.make_folds(o, "stratified", key="o_orderkey", target="o_orderstatus").frame
    return _r(A.auc(numeric(o.join(f, o["o_orderkey"] == f["row_key"]), ["o_custkey", "o_totalprice"], F.expr(_F01), ["fold"]), ["feature", "fold"]), "effect")


def _normal_p(z: str) -> str:
    """Two-sided, by Simpson's rule."""
    return f"1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: exp(-pow({z} * i / 2000.0, 2) / 2) * case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)) * {z} / 6000.0"


_MW = "select '{f}' feature, y, 2 * rank() over (order by {f}) + count(*) over (partition by {f}) - 1 r2, count(*) over (partition by {f}) t from (select *, " + _F01 + " y from orders)"


@query("with r as (" + " union all ".join(_MW.format(f=f) for f in ("o_custkey", "o_totalprice")) + f"), s as (select feature, cast(count(*) as double) n, cast(sum(y) as double) m, sum(r2 * y) / 2.0 s, sum(cast(t as double) * t - 1) ties from r group by feature), u as (select feature, n, m, s - m * (m + 1) / 2 u, ties from s), z as (select feature, n, u, u / (m * (n - m)) a, greatest(abs(u - m * (n - m) / 2) - 0.5, 0) / sqrt(m * (n - m) / 12 * (n + 1 - ties / (n * (n - 1)))) z from u) select feature, cast(n as bigint) n, round(greatest(a, 1 - a), 6) effect, u, round(z, 6) z, round({_normal_p('z')}, 6) + 0.0 p from z")
def mann_whitney_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.mann_whitney(numeric(_t(spark, sf, "orders"), ["o_custkey", "o_totalprice"], F.expr(_F01)), ["feature"]), "effect", "z", "p")


_EMB = "select 'v' || lpad(cast(i as varchar), 3, '0') feature, embedding[i] x, label y from (select embedding, label, unnest(range(1, len(embedding) + 1)) i from embeddings)"


@query(f"with l as ({_EMB}), r as (select feature, y, 2 * rank() over (partition by feature order by x) + count(*) over (partition by feature, x) - 1 r2, count(*) over (partition by feature) n from l), s as (select feature, y, max(n) n, (sum(r2) / 2.0 - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(n) - count(*))) a from r group by feature, y) select feature, max(n) n, round(avg(greatest(a, 1 - a)), 6) effect from s group by feature")
def auc_ovr_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    long = e.select(F.col("label").alias("y"), F.posexplode("embedding").alias("i", "x")).select(F.format_string("v%03d", F.col("i") + 1).alias("feature"), F.col("x").cast("double").alias("x"), "y")
    return _r(A.auc_ovr(long, ["feature"]), "effect")


@query("with t as (select l_quantity x, case when l_returnflag = 'R' then 1 else 0 end y from lineitem), r as (select y, 2 * rank() over (order by x) + count(*) over (partition by x) - 1 r2 from t) select 'l_quantity' feature, count(*) n, round(2 * (sum(r2 * y) / 2.0 - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) - 1, 6) + 0.0 effect from r")
def cliffs_delta_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.cliffs_delta(numeric(_t(spark, sf, "lineitem"), ["l_quantity"], F.expr("case when l_returnflag = 'R' then 1 else 0 end")), ["feature"]), "effect")


def _kruskal_sql(table: str, f: str, y: str) -> str:
    return f"with r as (select {y} y, rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 r, count(*) over (partition by {f}) t, count(*) over () n from {table}), g as (select y, sum(r) s, count(*) k from r group by y), q as (select sum(s * s / k) q from g), c as (select max(n) n, sum(cast(t as double) * t - 1) ties from r), h as (select n, (12.0 / (cast(n as double) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (cast(n as double) * n * n - n)) h from q, c) select '{f}' feature, n, round(h, 6) + 0.0 h, round(h / (n - 1), 6) + 0.0 effect, round(exp(-h / 2) * case (select count(*) from g) when 3 then 1 when 5 then 1 + h / 2 end, 6) + 0.0 p from h"


@query(_kruskal_sql("events", "value", "event_type"))
def kruskal_events(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.kruskal(numeric(_t(spark, sf, "events"), ["value"], F.col("event_type")), ["feature"]), "h", "effect", "p")


@query(_kruskal_sql("lineitem", "l_quantity", "l_returnflag"))
def kruskal_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.kruskal(numeric(_t(spark, sf, "lineitem"), ["l_quantity"], F.col("l_returnflag")), ["feature"]), "h", "effect", "p")


def _corr_p(r: str, n: str) -> str:
    """Two-sided tail of Student's t of a correlation, by Simpson's rule."""
    t, v = f"(abs({r}) * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2.0)"
    return f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * list_sum(list_transform(range(0, 20001), lambda i: pow(1 + pow({t} * i / 20000.0, 2) / {v}, -({v} + 1) / 2) * case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end)) * {t} / 60000.0)"


@query("with r as (select 'p_partkey' feature, 2 * rank() over (order by p_partkey) + count(*) over (partition by p_partkey) rx, 2 * rank() over (order by p_retailprice) + count(*) over (partition by p_retailprice) ry from part union all select 'p_size', 2 * rank() over (order by p_size) + count(*) over (partition by p_size), 2 * rank() over (order by p_retailprice) + count(*) over (partition by p_retailprice) from part), c as (select feature, count(*) n, corr(rx, ry) r from r group by feature) select feature, n, round(r, 6) + 0.0 r, round(abs(r), 6) effect, round(" + _corr_p("r", "n") + ", 6) + 0.0 p from c")
def spearman_part(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.spearman(numeric(_t(spark, sf, "part"), ["p_partkey", "p_size"], F.col("p_retailprice")), ["feature"]), "r", "effect", "p")


@query("with c as (select 'p_partkey' feature, count(*) n, corr(p_partkey, p_retailprice) r from part union all select 'p_size', count(*), corr(p_size, p_retailprice) from part) select feature, n, round(r, 6) + 0.0 r, round(abs(r), 6) effect, round(" + _corr_p("r", "n") + ", 6) + 0.0 p from c")
def pearson_part(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.pearson(numeric(_t(spark, sf, "part"), ["p_partkey", "p_size"], F.col("p_retailprice")), ["feature"]), "r", "effect", "p")


@query(f"select 'f' feature, count(*) n, round(corr({_F01}, o_totalprice), 6) + 0.0 r from orders")
def point_biserial_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.pearson(numeric(_t(spark, sf, "orders").withColumn("f", F.expr(_F01)), ["f"], F.col("o_totalprice")), ["feature"]).select("feature", "n", "r"), "r")


@query("with p as (select sign(cast(a.p_size - b.p_size as double)) dx, sign(a.p_retailprice - b.p_retailprice) dy from part a, part b where a.p_partkey < b.p_partkey) select 'p_size' feature, (select count(*) from part) n, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 6) + 0.0 effect from p")
def kendall_part(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.kendall(numeric(_t(spark, sf, "part"), ["p_size"], F.col("p_retailprice")), ["feature"]), "effect")


def _eta_sql(table: str, f: str, y: str) -> str:
    return f"select '{f}' feature, count(*) n, round(sum((g - m) * (g - m)) / sum((y - m) * (y - m)), 6) + 0.0 effect from (select {y} y, avg({y}) over (partition by {f}) g, avg({y}) over () m from {table})"


@query(" union all ".join(_eta_sql("customer", f, "c_acctbal") for f in ("c_mktsegment", "c_nationkey")))
def eta_squared_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.eta_squared(categorical(_t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], F.col("c_acctbal")), ["feature"]), "effect")


def _chi_sql(table: str, f: str, y: str, effect: str) -> str:
    return f"(with o as (select {f} x, {y} y, count(*) n from {table} group by 1, 2), m as (select *, sum(n) over (partition by x) nx, sum(n) over (partition by y) ny from o), c as (select cast(sum(n) as double) n, count(distinct x) r, count(distinct y) k, sum(n) * (sum(n * 1.0 * n / (cast(nx as double) * ny)) - 1) chi from m) select '{f}' feature, cast(n as bigint) n, round({effect}, 6) + 0.0 effect from c)"


_BERGSMA = "sqrt(greatest(0, chi / n - (k - 1) * (r - 1) / (n - 1)) / (least((r * n - r * r + r - 1) / (n - 1), (k * n - k * k + k - 1) / (n - 1)) - 1))"


@query(" union all ".join(_chi_sql("lineitem", f, "l_returnflag", _BERGSMA) for f in ("l_linestatus", "l_linenumber")))
def bergsma_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.bergsma_v(categorical(_t(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag")), ["feature"]), "effect")


@query(" union all ".join(_chi_sql("lineitem", f, "l_returnflag", "sqrt(greatest(chi, 0) / n / least(r - 1, k - 1))") for f in ("l_linestatus", "l_linenumber")))
def cramers_v_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _r(A.cramers_v(categorical(_t(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag")), ["feature"]), "effect")


# information

_WOE = "with l as (select lang x, count_if(quality = 0) g, count_if(quality = 1) b from documents join labels using (doc_id) group by 1), t as (select *, sum(g) over () tg, sum(b) over () tb from l), w as (select x, g, b, ln(((g + 0.5) / (tg + 0.5)) / ((b + 0.5) / (tb + 0.5))) woe, g / tg - b / tb d from t)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return categorical(_t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id"), ["lang"], F.col("quality"))


@query(_WOE + " select 'lang' feature, x, cast(g as bigint) g, cast(b as bigint) b, round(woe, 6) + 0.0 woe, round(d * woe, 6) + 0.0 iv from w")
def woe_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _r(I.woe_table(I.level_cells(_labelled(spark, sf), ["feature"]), ["feature"]), "woe", "iv")


@query(_WOE + " select 'lang' feature, cast(sum(g + b) as bigint) n, round(sum(d * woe), 6) + 0.0 effect from w")
def information_value_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _r(I.information_value(_labelled(spark, sf), ["feature"]), "effect")


_MERGED = "with recursive l as (select 'p_name' feature, p_name x, count_if(p_size <= 25) g, count_if(p_size > 25) b from part group by 2 union all select 'p_brand', p_brand, count_if(p_size <= 25), count_if(p_size > 25) from part group by 2), o as (select *, g + b n, row_number() over (partition by feature order by b / (g + b), x) i, sum(g + b) over (partition by feature) total from l), m as (select feature, i, n, total, cast(0 as bigint) bin, case when n >= 0.05 * total and total - n >= 0.05 * total then 1 else 0 end closed, cast(n as double) held, cast(total - n as double) rest from o where i = 1 union all select o.feature, o.i, o.n, o.total, m.bin + m.closed, case when o.n + case when m.closed = 1 then 0 else m.held end >= 0.05 * o.total and m.rest - o.n >= 0.05 * o.total then 1 else 0 end, o.n + case when m.closed = 1 then 0 else m.held end, m.rest - o.n from m join o on o.feature = m.feature and o.i = m.i + 1), q as (select o.feature, bin, sum(g) g, sum(b) b from o join m using (feature, i) group by 1, 2), t as (select *, sum(g) over (partition by feature) tg, sum(b) over (partition by feature) tb from q) select feature, cast(sum(g + b) as bigint) n, round(sum((g / tg - b / tb) * ln(((g + 0.5) / (tg + 0.5)) / ((b + 0.5) / (tb + 0.5)))), 6) + 0.0 effect from t group by feature"


@query(_MERGED)
def information_value_merged_part(spark: SparkSession, sf: str) -> DataFrame:
    return _r(I.information_value(categorical(_t(spark, sf, "part"), ["p_name", "p_brand"], F.expr("case when p_size > 25 then 1 else 0 end")), ["feature"], binning="merge"), "effect")


_PF = "f as (select p_partkey k, cast((row_number() over (order by md5('42|' || p_partkey), p_partkey) - 1) % 5 + 1 as int) fold from part)"


@query(f"with {_PF}, l as (select fold, p_name x, count_if(p_size <= 25) g, count_if(p_size > 25) b from part join f on k = p_partkey group by 1, 2), a as (select x, sum(g) g, sum(b) b from l group by 1), t as (select s.f, a.x, coalesce(l.g, 0) eg, coalesce(l.b, 0) eb, a.g - coalesce(l.g, 0) rg, a.b - coalesce(l.b, 0) rb from a cross join range(1, 6) s(f) left join l on l.x = a.x and l.fold = s.f), q as (select *, sum(eg) over (partition by f) teg, sum(eb) over (partition by f) teb, sum(rg) over (partition by f) trg, sum(rb) over (partition by f) trb from t), i as (select f, sum((eg / teg - eb / teb) * case when rg + rb > 0 then ln(((rg + 0.5) / (trg + 0.5)) / ((rb + 0.5) / (trb + 0.5))) else 0 end) iv from q group by f) select 'p_name' feature, (select count(*) from part) n, round(avg(iv), 6) + 0.0 effect from i")
def iv_oof_part(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    f = E.make_folds(p, "plain", key="p_partkey")
    return _r(I.iv_oof(categorical(p.join(f.frame, p["p_partkey"] == F.col("row_key")), ["p_name"], F.expr("case when p_size > 25 then 1 else 0 end"), ["fold"]), ["feature"], f), "effect")


@query(f"with {_PF}, t as (select fold, p_name x, p_retailprice y from part join f on k = p_partkey), c as (select fold, x, count(*) n, sum(y) s from t group by 1, 2), a as (select x, sum(n) n, sum(s) s from c group by 1), g as (select fold, count(*) n, sum(y) s from t group by 1), tot as (select count(*) n, sum(y) s from t), e as (select t.y, case when a.n - c.n > 0 then (a.s - c.s) / (a.n - c.n) else (tot.s - g.s) / (tot.n - g.n) end e, avg(t.y) over () m from t join c using (fold, x) join a using (x) join g using (fold), tot) select 'p_name' feature, count(*) n, round(greatest(0.0, 1 - sum((y - e) * (y - e)) / sum((y - m) * (y - m))), 6) + 0.0 effect from e")
def target_eta_oof_part(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    f = E.make_folds(p, "plain", key="p_partkey")
    return _r(I.target_eta_oof(categorical(p.join(f.frame, p["p_partkey"] == F.col("row_key")), ["p_name"], F.col("p_retailprice"), ["fold"], nulls=True), ["feature"], f), "effect")


_U = "select cast((p_partkey * 37) % 101 as double) x, case when abs((p_partkey * 37) % 101 - 50) > 25 then 1 else 0 end y from part"


@query(f"with t as ({_U}), q as (select list_distinct(quantile_cont(x, [cast(0.1 as double), cast(0.2 as double), cast(0.3 as double), cast(0.4 as double), cast(0.5 as double), cast(0.6 as double), cast(0.7 as double), cast(0.8 as double), cast(0.9 as double)])) q from t), b as (select x, y, len(list_filter(q, lambda e: e <= x)) bin from t, q), z as (select x, y, avg(y) over (partition by bin) v from b), r as (select y, 2 * rank() over (order by v) + count(*) over (partition by v) - 1 rv, 2 * rank() over (order by x) + count(*) over (partition by x) - 1 rx from z), a as (select (sum(rv * y) / 2.0 - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) v, (sum(rx * y) / 2.0 - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) x from r) select 'x' feature, round(greatest(v, 1 - v) - greatest(x, 1 - x), 6) + 0.0 gap from a")
def shape_gap_part(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select(F.expr("cast((p_partkey * 37) % 101 as double)").alias("x"), F.expr("case when abs((p_partkey * 37) % 101 - 50) > 25 then 1 else 0 end").alias("y"))
    return _r(I.shape_gap(numeric(p, ["x"], F.col("y")), ["feature"]), "gap")


# drift, resampling

_TENTHS = "[" + ", ".join(f"cast({k / 10} as double)" for k in range(11)) + "]"


@query(f"with e as (select value x from events where event_id % 2 = 0), a as (select value * 1.1 x from events where event_id % 2 = 1), q as (select list_sort(list_distinct(quantile_cont(x, {_TENTHS}))) q from e), i as (select q[2:len(q) - 1] q from q), s as (select bin, sum(e) e, sum(a) a from (select len(list_filter(q, lambda v: v <= x)) bin, 1 e, 0 a from e, i union all select len(list_filter(q, lambda v: v <= x)), 0, 1 from a, i) group by bin), p as (select greatest(e / sum(e) over (), 1e-6) e, greatest(a / sum(a) over (), 1e-6) a from s) select round(sum((a - e) * ln(a / e)), 6) + 0.0 psi, count(*) bins from p")
def psi_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return _r(D.psi(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("value", F.col("value") * 1.1), "value"), "psi")


@query("with c as (select corr(p_partkey, p_retailprice) r from part) select k as \"column\", round(1 / (1 - r * r), 6) vif from c, (values ('p_partkey'), ('p_retailprice')) t(k)")
def vif_part(spark: SparkSession, sf: str) -> DataFrame:
    found = D.vif(_t(spark, sf, "part"), ["p_partkey", "p_retailprice"])
    return _r(spark.createDataFrame(list(found.items()), "`column` string, vif double"), "vif")


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} ({v}) * {_det([[*r[:j], *r[j + 1 :]] for r in m[1:]])}" for j, v in enumerate(m[0])) + ")"


def _minor(m: list[list[str]], i: int, j: int) -> str:
    return _det([[v for b, v in enumerate(r) if b != j] for a, r in enumerate(m) if a != i])


_VIF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_R4 = [["1" if a == b else f"r{min(a, b)}{max(a, b)}" for b in range(4)] for a in range(4)]


@query("with c as (select " + ", ".join(f"corr({_VIF[a]}, {_VIF[b]}) r{a}{b}" for a in range(4) for b in range(a + 1, 4)) + " from lineitem) " + " union all ".join(f"select '{c}' as \"column\", round({_minor(_R4, i, i)} / {_det(_R4)}, 6) vif from c" for i, c in enumerate(_VIF)))
def vif_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    found = D.vif(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _r(spark.createDataFrame(list(found.items()), "`column` string, vif double"), "vif")


_P = "select n_nationkey k, cast((n_nationkey * 7 % 25 + 1) as double) / 400 p from nation"


@query(f"with t as ({_P}), r as (select k, p, count(*) over () m, row_number() over (order by p, k) i from t) select k, p, round(least(1.0, min(p * m / i) over (order by i rows between current row and unbounded following)), 9) q from r")
def bh_fdr_nation(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.expr("cast((n_nationkey * 7 % 25 + 1) as double) / 400").alias("p"))
    return _r(S.bh_fdr(n), "q", places=9)


@query("with t as (select p_retailprice x, case when p_size > 25 then 1 else 0 end y from part), m as (select sum(t) v from (select cast(count(*) as double) * count(*) * count(*) - count(*) t from t group by x)), p as (select cast(sum(y) as double) v from t) select 'ties' margin, v, cast(50 as bigint) replicates from m union all select 'positives', v, 50 from p")
def permutation_margins_part(spark: SparkSession, sf: str) -> DataFrame:
    """The draws that relevance() makes: each of 50 permutations keeps the rows of every value and class."""
    long = numeric(_t(spark, sf, "part"), ["p_retailprice"], F.expr("case when p_size > 25 then 1 else 0 end"))
    each = [S.replicates(long, m, 0, 50, 42, block=300).select(F.lit(m).alias("margin"), F.explode("v").alias("v")) for m in ("ties", "positives")]
    return each[0].unionByName(each[1]).groupBy("margin", "v").agg(F.count(F.lit(1)).alias("replicates"))


@query()
def shadow_floor_part(spark: SparkSession, sf: str) -> DataFrame:
    long = numeric(_t(spark, sf, "part"), ["p_retailprice"], F.expr("case when p_size > 25 then 1 else 0 end"))
    return S.resample(long, {"p_retailprice": "AUC"}, 0).select("feature", F.size("shadow").alias("shadows"), F.array_max("shadow").alias("highest"))


@query()
def bootstrap_orders(spark: SparkSession, sf: str) -> DataFrame:
    long = numeric(_t(spark, sf, "orders"), ["o_custkey", "o_totalprice"], F.expr(_F01))
    return S.resample(long, {"o_custkey": "AUC", "o_totalprice": "AUC"}).select("feature", "ci_lo", "ci_hi", F.size("shadow").alias("shadows"))


# redundancy, leaks


def _rho(table: str, a: str, b: str) -> str:
    return f"select '{a}' a, '{b}' b, round(abs(corr(x, y)), 6) score from (select 2 * rank() over (order by {a}) + count(*) over (partition by {a}) x, 2 * rank() over (order by {b}) + count(*) over (partition by {b}) y from {table})"


_PAIRS = " union all ".join([_rho("part", a, b) for a, b in (("p_partkey", "p_retailprice"), ("p_partkey", "p_size"), ("p_retailprice", "p_size"))] + [f"select 'p_brand' a, feature b, round(sqrt(effect), 6) score from ({_eta_sql('part', 'p_brand', c).replace(chr(39) + 'p_brand' + chr(39), chr(39) + c + chr(39), 1).replace('round(', '(').replace(', 6) + 0.0', ')')})" for c in ("p_partkey", "p_retailprice", "p_size")] + [_chi_sql("part", "p_brand", "p_type", _BERGSMA)[:-1].replace("select 'p_brand' feature, cast(n as bigint) n, ", "select 'p_brand' a, 'p_type' b, ").replace("effect from c", "score from c") + ")"] + [f"select feature a, 'p_type' b, round(sqrt(effect), 6) score from ({_eta_sql('part', 'p_type', c).replace(chr(39) + 'p_type' + chr(39), chr(39) + c + chr(39), 1).replace('round(', '(').replace(', 6) + 0.0', ')')})" for c in ("p_partkey", "p_retailprice", "p_size")])


@query(_PAIRS)
def pairwise_part(spark: SparkSession, sf: str) -> DataFrame:
    return _r(R.pairwise(_t(spark, sf, "part"), {"p_partkey": "count", "p_retailprice": "continuous", "p_size": "count", "p_brand": "nominal", "p_type": "nominal"}), "score")


_TWIN = "(select c_acctbal, c_nationkey, c_mktsegment, c_acctbal * 2 twice, md5(c_mktsegment) code from customer)"


@query("with e as (select a, b from (" + _rho(_TWIN, "c_acctbal", "twice") + " union all " + _rho(_TWIN, "c_acctbal", "c_nationkey") + " union all " + _rho(_TWIN, "c_nationkey", "twice") + ") where score >= 0.95 union all select 'c_mktsegment', 'code' from (" + _chi_sql(_TWIN, "c_mktsegment", "code", _BERGSMA) + ") where effect >= 0.95) select a representative, a member from e union all select a, b from e")
def redundant_groups_customer(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").withColumn("twice", F.col("c_acctbal") * 2).withColumn("code", F.md5("c_mktsegment"))
    types = {"c_acctbal": "continuous", "twice": "continuous", "c_nationkey": "count", "c_mktsegment": "nominal", "code": "nominal"}
    rows = [(R.representative(g, {}, {}), c) for g in R.components(R.pairwise(df, types)) for c in g]
    return spark.createDataFrame(rows, "representative string, member string")


_SQUARE = ("p_brand", "p_partkey", "p_retailprice", "p_size", "p_type")


@query(f"with p as ({_PAIRS}), b as (select a, b, score from p union all select b, a, score from p union all select distinct a, a, 1.0 from (select a from p union all select b from p)) select a as \"column\", " + ", ".join(f"max(case when b = '{c}' then score end) {c}" for c in _SQUARE) + " from b group by a")
def similarity_matrix_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.similarity_matrix(pairwise_part(spark, sf))


_LATE = "select l_shipdate, o_orderdate, l_shipdate + interval 30 day due, cast(l_quantity as varchar) q from lineitem join orders on l_orderkey = o_orderkey"


@query("with t as (select l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey), f as (select avg(case when l_shipdate > o_orderdate then 1.0 else 0 end) f from t) select 'D' part, 'l_shipdate' as \"column\", 'future-timestamp' detector, 'future' ltype, printf('%.1f', f * 100) || '% after ref' evidence from f where f > 0")
def future_timestamps_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    j = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "o_orderdate", "l_quantity", "l_returnflag")
    return L.future_timestamps(j, F.col("o_orderdate"), ["o_orderdate"])


_SPLIT = (
    f"with t as (select {_F01} y, case when {_F01} = 1 then 'done' else o_orderpriority end hit, o_orderpriority, cast(o_custkey as double) o_custkey, o_totalprice + {_F01} * 1e9 mark from orders), "
    + "l as (select 'hit' c, hit v, count(*) n, avg(y) m from t group by hit union all select 'o_orderpriority', o_orderpriority, count(*), avg(y) from t group by o_orderpriority), "
    + "a as (" + _auc_sql("t", ["mark", "o_custkey"], "y") + "), f as (select distinct c, 'pure level' e from l where n >= 5 and m in (0, 1) union all select feature, printf('AUC %.3f', effect) from a where effect >= 0.999) "
    + "select 'F' part, c as \"column\", 'perfect-separation' detector, 'direct' ltype, e evidence from f"
)


@query(_SPLIT)
def separation_orders(spark: SparkSession, sf: str) -> DataFrame:
    y = F.expr(_F01)
    df = _t(spark, sf, "orders").withColumn("hit", F.when(y == 1, F.lit("done")).otherwise(F.col("o_orderpriority"))).withColumn("mark", F.col("o_totalprice") + y * 1e9)
    return L.separation(df, y, ["hit", "mark", "o_custkey", "o_orderpriority"])


_EFF = "select 'f' || n_nationkey as \"column\", case when n_nationkey % 5 = 0 then 'IV' else 'AUC' end metric_name, case when n_nationkey = 7 then 0.99 else 0.5 + n_nationkey % 4 * 0.01 end effect from nation"


def _effects(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.expr("concat('f', n_nationkey)").alias("column"), F.expr("case when n_nationkey % 5 = 0 then 'IV' else 'AUC' end").alias("metric_name"), F.expr("cast(case when n_nationkey = 7 then 0.99 else 0.5 + n_nationkey % 4 * 0.01 end as double)").alias("effect"))


@query(f"with e as (select \"column\", metric_name, cast(effect as double) effect from ({_EFF})), m as (select *, median(effect) over (partition by metric_name) med from e), d as (select *, median(abs(effect - med)) over (partition by metric_name) mad from m) select 'F' part, \"column\", 'outlier-effect-vs-peers' detector, 'direct' ltype, printf('%.3f', effect) evidence from d where (effect - med) / (1.4826 * case when mad = 0 then 1e-9 else mad end) > 3.5")
def effect_outliers_nation(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_outliers(_effects(spark, sf))


@query(f"select 'F' part, \"column\", 'effect-above-backstop' detector, 'direct' ltype, printf('%.3f', effect) evidence from ({_EFF}) where effect >= 0.85")
def effect_backstop_nation(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_backstop(_effects(spark, sf), H.LEAK_FLAG["AUC"])


_SIGNALS = [("C", "a_score", "target-like-name", "direct", ""), ("F", "a_score", "effect-above-backstop", "direct", ""), ("F", "b", "effect-above-backstop", "direct", ""), ("D", "c", "missingness-predicts-target", "execution", ""), ("F", "c", "outlier-effect-vs-peers", "direct", ""), ("F", "c", "outlier-effect-vs-peers", "direct", ""), ("D", "d", "future-timestamp", "future", "")]


@query("with s(part, c, d, l, e, seq) as (values " + ", ".join(str((*r, i)) for i, r in enumerate(_SIGNALS)) + f"), g as (select c, count(distinct d) k, bool_or(d in {L.STRONG}) strong from s group by c), f as (select distinct on (c) c, d, l from s order by c, d in {L.STRONG} desc, seq) select c as \"column\", d || ':' || l || case when k > 1 then ' (+' || (k - 1) || ')' else '' end leak from g join f using (c) where strong or k > 1")
def adjudicate_signals(spark: SparkSession, sf: str) -> DataFrame:
    return L.adjudicate(spark.createDataFrame([(*r, i) for i, r in enumerate(_SIGNALS)], L.SIGNAL + ", seq int"))


_NAMES = ("doc_id", "quality", "toxic", "vec_id", "embedding", "label")


@query("select 'C' part, c as \"column\", 'target-like-name' detector, 'direct' ltype, lower(c) evidence from (select unnest([" + ", ".join(f"'{c}'" for c in _NAMES) + "]) c) where c <> 'toxic' and regexp_matches(lower(c), '_final|_flag|label|outcome|prediction|proba|score|target')")
def name_signals_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.name_signals(spark, [*_t(spark, sf, "labels").columns, *_t(spark, sf, "embeddings").columns], "toxic")


# ledger reports

_LEDGER = "select p_name || '-' || p_partkey as \"column\", p_type semantic_type, case p_partkey % 4 when 0 then 'keep' when 1 then 'drop' when 2 then 'redundant' else 'review' end verdict, 'AUC' metric_name, case when p_partkey % 10 > 0 then p_retailprice end effect, case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then 'weak (' || p_size || ')' else 'copy of ''x''' end reason from part"


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    _t(spark, sf, "part").createOrReplaceTempView("__ledger_source")
    return spark.sql(_LEDGER.replace('"column"', "`column`").replace("from part", "from __ledger_source").replace("'copy of ''x'''", "\"copy of 'x'\""))


@query(f'select "column", cast(row_number() over (partition by semantic_type order by effect desc nulls last, "column") as int) "rank" from ({_LEDGER})')
def rank_within_type_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.rank_within_type(_ledger(spark, sf))


@query(f"select \"column\", semantic_type, metric_name, effect, reason from ({_LEDGER}) where verdict = 'keep' order by effect desc nulls last, \"column\" limit 10")
def top_keeps_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.top_keeps(_ledger(spark, sf))


@query(f'select "column", effect from ({_LEDGER}) where effect is not null order by effect desc, "column" limit 20')
def effect_ranking_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.effect_ranking(_ledger(spark, sf))


@query(f"select trim(regexp_replace(coalesce(reason, ''), '[(''\"].*', '')) rule, count(*) n from ({_LEDGER}) where verdict in ('drop', 'structural-drop', 'redundant') group by 1")
def drop_rate_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.drop_rate_by_rule(_ledger(spark, sf))


@query(f"with l as ({_LEDGER}) select 'columns' item, '' as name, count(*) n from l union all select 'verdict', verdict, count(*) from l group by 2 union all select 'rule', trim(regexp_replace(coalesce(reason, ''), '[(''\"].*', '')), count(*) from l where verdict in ('drop', 'structural-drop', 'redundant') group by 2")
def scorecard_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.scorecard(_ledger(spark, sf))


@query(f"select * from ({_LEDGER}) where verdict = 'review'")
def review_worklist_part(spark: SparkSession, sf: str) -> DataFrame:
    return O.review_worklist(_ledger(spark, sf))


@query("with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select cast(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) as int) bin, count(*) n from lineitem, e group by 1")
def histogram_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return O.histogram(_t(spark, sf, "lineitem"), "l_extendedprice")


@query(f"with t as ({_GAPS}) select * from (unpivot (select " + ", ".join(f"round(avg(case when {c} is null then 1.0 else 0 end), 4) {c}" for c in "yabcde") + ' from t) on y, a, b, c, d, e into name "column" value missing) order by missing desc, "column" limit 3')
def missingness_top_events(spark: SparkSession, sf: str) -> DataFrame:
    return O.missingness_top(P.missingness(_gap_events(spark, sf)), 3)


# survival

_LIFE = "with h as (select cast(max(o_orderdate) as date) hi from orders), d as (select o_custkey, date_diff('day', cast(min(o_orderdate) as date), max(hi)) span from orders, h group by 1), l as (select cast(span as double) t, case when c_acctbal > 0 then 1 else 0 end e, c_acctbal x, cast(c_nationkey as double) z, c_mktsegment g from customer join d on o_custkey = c_custkey)"


def _life(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    per = o.groupBy("o_custkey").agg(F.min(day).alias("lo")).crossJoin(F.broadcast(o.agg(F.max(day).alias("hi"))))
    return _t(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey")).select(F.datediff("hi", "lo").cast("double").alias("t"), F.expr("case when c_acctbal > 0 then 1 else 0 end").alias("e"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("z"), F.col("c_mktsegment").alias("g"))


@query(_LIFE + ", r as (select t, e, z r from l), p as (select a.r ra, b.r rb from r a, r b where a.e = 1 and (b.t > a.t or (b.t = a.t and b.e = 0))) select 'z' feature, count(*) pairs, round(avg(case when ra > rb then 1.0 when ra = rb then 0.5 else 0 end), 6) cindex from p")
def concordance_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _r(V.concordance(_life(spark, sf), "t", "e", ["z"]), "cindex")


@query(_LIFE + ", w as (select t, cast(e as bigint) e, g from l), ev as (select distinct t from w where e = 1), r as (select ev.t, g, count(*) rg, count_if(w.t = ev.t and e = 1) d from ev, w where w.t >= ev.t group by 1, 2), s as (select t, g, rg, d, sum(rg) over (partition by t) ra, sum(d) over (partition by t) da from r) select g, cast(sum(d) as bigint) observed, round(sum(da * rg / ra), 6) expected from s group by g")
def logrank_parts_customer(spark: SparkSession, sf: str) -> DataFrame:
    t = V.logrank_parts(_life(spark, sf), "t", "e", "g")
    return _r(t.groupBy("g").agg(F.sum("d").alias("observed"), F.sum(F.col("da") * F.col("rg") / F.col("ra")).alias("expected")), "expected")


_V4 = [[f"v{min(a, b)}{max(a, b)}" for b in range(4)] for a in range(4)]
_X2 = "(" + " + ".join(f"z{i} * z{j} * {'-' if (i + j) % 2 else ''}{_minor(_V4, i, j)}" for i in range(4) for j in range(4)) + f") / {_det(_V4)}"


@query(_LIFE + ", w as (select t, cast(e as bigint) e, dense_rank() over (order by g) - 1 k from l), ev as (select distinct t from w where e = 1), r as (select ev.t, " + ", ".join(f"cast(count_if(k = {i}) as double) r{i}, cast(count_if(k = {i} and w.t = ev.t and e = 1) as double) d{i}" for i in range(5)) + " from ev, w where w.t >= ev.t group by ev.t), s as (select *, r0 + r1 + r2 + r3 + r4 ra, d0 + d1 + d2 + d3 + d4 da from r), f as (select *, case when ra > 1 then da * (ra - da) / (ra - 1) else 0 end h from s), m as (select " + ", ".join(f"sum(d{i} - da * r{i} / ra) z{i}" for i in range(4)) + ", " + ", ".join(f"sum(h * (r{i} / ra) * ({int(i == j)} - r{j} / ra)) v{i}{j}" for i in range(4) for j in range(i, 4)) + f" from f), x as (select {_X2} x from m) select round(x, 6) statistic, round(exp(-x / 2) * (1 + x / 2), 6) p from x")
def logrank_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _r(spark.createDataFrame([V.logrank(_life(spark, sf), "t", "e", "g")], "statistic double, p double"), "statistic", "p")


@query()
def cox_customer(spark: SparkSession, sf: str) -> DataFrame:
    found = V.cox_screen(_life(spark, sf), "t", "e", ["x", "z"])
    return _r(spark.createDataFrame([(f, r["beta"], r["hr"], r["p"], r["cindex"]) for f, r in found.items()], "feature string, beta double, hr double, p double, cindex double"), "beta", "hr", "p", "cindex")


# whole runs


@query()
def crosscheck_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn("y", F.expr("case when o_totalprice > 250000 then 1 else 0 end"))
    found = X.crosscheck(o, ["o_totalprice", "o_custkey", "o_orderpriority"], "y", "binary")
    return spark.createDataFrame(list(found.items()), "`column` string, status string")


@query()
def relevance_events(spark: SparkSession, sf: str) -> DataFrame:
    run = open_run(spark, _t(spark, sf, "events").withColumn("y", F.expr("case when event_type = 'purchase' then 1 else 0 end")), f"{shared_folder(spark)}/runs", target="y", target_type="binary", row_key="event_id")
    run.freeze(E.make_folds(run.df, "stratified", target="y"))
    found = RL.relevance(run, {"value": "continuous", "user_id": "count"})
    rows = [(f, r["metric_name"], r["effect"], r["p"], r["q_value"], r["shadow_floor"]) for f, r in found.items()]
    return _r(spark.createDataFrame(rows, "`column` string, metric_name string, effect double, p double, q_value double, shadow_floor double"), "effect", "p", "q_value", "shadow_floor")


@query()
def screen_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn("y", F.expr("case when o_totalprice > 250000 then 1 else 0 end")).withColumn("price_score", F.col("o_totalprice") * 2)
    run = open_run(spark, o, f"{shared_folder(spark)}/runs", target="y", target_type="binary", row_key="o_orderkey")
    return RL.screen(run, "stratified").drop("effect_ci")


@query("select * from (values ('customer_id', 'structural-drop'), ('signal', 'keep'), ('noise', 'drop'), ('region', 'drop'), ('constant', 'structural-drop'), ('leak_score', 'leak-suspect'), ('signal_dup', 'structural-drop')) t(\"column\", verdict)")
def screen_known_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Parts A to H over planted columns of orders, whose verdicts are known."""
    u = lambda k: (F.pmod(F.xxhash64("o_orderkey", F.lit(k)), F.lit(100_003)) / 100_003.0)
    bell = u(1) + u(2) + u(3) - 1.5
    y = (u(4) < 0.5).cast("int")
    o = keep(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("customer_id"), y.alias("churn"), (y + bell).alias("signal"), (u(5) + u(6) + u(7)).alias("noise"), F.substring("o_orderpriority", 1, 1).alias("p"), F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (u(8) * 4).cast("int") + 1).alias("region"), F.lit(7).alias("constant"), y.cast("double").alias("leak_score"), (y + bell).alias("signal_dup")).drop("p"))
    run = open_run(spark, o, f"{shared_folder(spark)}/runs", target="churn", target_type="binary", row_key="customer_id")
    return RL.screen(run, "stratified").select("column", "verdict")


@query("with q as (select list_sort(list_distinct(quantile_cont(value, " + _TENTHS + "))) q from events), i as (select q[2:len(q) - 1] q from q) select date_trunc('day', cast(ts as timestamp)) start, cast(len(list_filter(q, lambda v: v <= value)) as int) bin, count(*) n from events, i group by 1, 2")
def windowed_counts_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return W.windowed_counts(e, "value", D.quantile_edges(e, "value"), "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))

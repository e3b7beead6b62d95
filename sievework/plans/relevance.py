"""Effects of all features on the target, guarded by frozen folds; the dispatch table; decisions; the whole run."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import derive_datetime, hurdle_split, number
from ..functions.thresholds import AUTO_DROP, COX_P, FEATURE_TYPES, LEAK_FLAG, TARGET_TYPES, cramers_v_floor, folds_viable, power_flag, recommended_k, suggest_strategy, tier_for, viable
from ..operators import association as A
from ..operators import crosscheck as X
from ..operators import folds as folds_
from ..operators import information as I
from ..operators import leakage as L
from ..operators import profile as P
from ..operators import redundancy as R
from ..operators import resampling as S
from ..operators import survival as V
from ..operators.longform import categorical, numeric
from ..operators.report import rank_within_type
from ..sources.scratch import keep
from .run import Run, target_column

NUMERIC = ("continuous", "count")


@dataclass(frozen=True)
class Metric:
    """plan gives (by, n, effect and maybe p) of a long table. numeric: is x a number."""

    name: str
    kind: str = "assoc"
    plan: object = None
    numeric: bool = True
    p: bool = False


def metric_for(feature_type: str, target_type: str) -> Metric:
    """The first metric of a feature type and target type; ValueError for an unknown one."""
    if feature_type not in FEATURE_TYPES or target_type not in TARGET_TYPES:
        raise ValueError(f"no metric for a feature of type {feature_type!r} and a target of type {target_type!r}")
    special = Metric("derive-first", kind="derive") if feature_type == "datetime" else Metric("C-index", kind="survival") if target_type == "survival" else None
    if special:
        return special
    ordered = feature_type in (*NUMERIC, "ordinal")
    if target_type == "binary":
        return Metric("AUC", plan=A.mann_whitney, p=True) if feature_type in NUMERIC else Metric("IV", plan=I.information_value, numeric=False)
    if target_type == "multiclass":
        return Metric("KW ε²", plan=A.kruskal, p=True) if feature_type in NUMERIC else Metric("Cramér's V", plan=A.bergsma_v, numeric=False)
    if ordered:
        return Metric("Spearman ρ", plan=A.spearman, p=True)
    if feature_type == "binary":
        return Metric("Cliff's δ", plan=_cliffs_of_target, numeric=False) if target_type == "ordinal" else Metric("point-biserial", plan=A.pearson, p=True)
    if target_type == "ordinal":
        return Metric("Cramér's V", plan=A.bergsma_v, numeric=False)
    return Metric("η²", plan=A.eta_squared, numeric=False)


def _cliffs_of_target(long: DataFrame, by: list[str]) -> DataFrame:
    """The target is the quantity, the two levels of the feature are the groups."""
    top = long.groupBy(*by).agg(F.max("x").alias("__hi"), F.count_distinct("x").alias("__k")).where("__k = 2")
    turned = long.join(F.broadcast(top), by).select(*by, F.col("y").cast("double").alias("x"), (F.col("x") == F.col("__hi")).cast("int").alias("y"))
    return A.cliffs_delta(turned, by).withColumn("effect", F.abs("effect"))


def _nan(v) -> float:
    return float("nan") if v is None else float(v)


def relevance(run: Run, features: dict[str, str], ci_b=200, shadow_b=50) -> dict[str, dict]:
    """feature -> column, metric_name, effect, effect_ci, p, q_value, shape_gap, fold_spread, shadow_floor, power_flag, n.

    Raises GateFailure without frozen folds. Features of one metric are one plan. Effects are over the rows that some fold
    trains on, fold_spread is the standard deviation of the effects in the test blocks, q_value is over all features of
    the call. Intervals and floors come from tables of counts (see resampling)."""
    folds = run.guard("relevance")
    ttype = run.frame.target_type or "binary"
    rows = run.df.join(folds.frame.withColumnRenamed("fold", "__fold"), "row_key")
    out: dict[str, dict] = {}
    groups: dict[tuple, list[str]] = {}
    for f, kind in features.items():
        oof = kind == "high_card" and ttype in ("binary", "regression")
        m = metric_for(kind, ttype)
        groups.setdefault(("oof" if oof else m.kind, m), []).append(f)
    y = None if ttype == "survival" else target_column(run)
    for (kind, m), fs in groups.items():
        if kind == "derive":
            out |= {f: {"column": f, "metric_name": "derive-first"} for f in fs}
        elif kind == "survival":
            out |= _survival(run, fs, shadow_b)
        elif kind == "oof":
            out |= _out_of_fold(run, rows, folds, fs, ttype, y, shadow_b)
        else:
            out |= _association(run, rows, folds, m, fs, {f: features[f] for f in fs}, ttype, y, ci_b, shadow_b)
    tested = [f for f in features if "p" in out[f]]
    if tested:
        t = run.spark.createDataFrame([(f, _nan(out[f]["p"])) for f in tested], "column string, p double")
        for r in S.bh_fdr(t).collect():
            out[r["column"]]["q_value"] = _nan(r["q"])
    return {f: out[f] for f in features}


def _association(run, rows, folds, m, fs, kinds, ttype, y, ci_b, shadow_b) -> dict[str, dict]:
    build = numeric if m.numeric else categorical
    long = keep(build(rows, fs, y, ["__fold"]))  # read eight times
    screened = long.where(folds.is_screened(F.col("__fold"))).drop("__fold")
    effects = {r["feature"]: r.asDict() for r in m.plan(screened, ["feature"]).collect()}
    tested = long.where(F.col("__fold") > 0).withColumnRenamed("__fold", "fold")
    spread: dict[str, list] = {}
    for r in m.plan(tested, ["feature", "fold"]).collect():
        spread.setdefault(r["feature"], []).append(_nan(r["effect"]))
    n = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {r["feature"]: r for r in S.resample(screened, dict.fromkeys(fs, m.name), ci_b, shadow_b, run.frame.seed).collect()}
    gaps = {}
    shaped = [f for f in fs if ttype == "binary" and kinds[f] in NUMERIC]
    if shaped:
        gaps = {r["feature"]: r["gap"] for r in I.shape_gap(screened.where(F.col("feature").isin(*shaped)), ["feature"]).collect()}
    out = {}
    for f in fs:
        e, d = effects.get(f, {}), drawn.get(f)
        shadow = np.array(d["shadow"], float) if d else np.zeros(0)
        effect = _nan(e.get("effect"))
        good = [v for v in spread.get(f, []) if v == v]
        out[f] = {
            "column": f, "effect": effect, "metric_name": m.name, "effect_ci": (round(_nan(d["ci_lo"]), 4), round(_nan(d["ci_hi"]), 4)) if d else (math.nan, math.nan),
            "p": _nan(e.get("p")) if m.p else S.permutation_p(effect, shadow), "shape_gap": _nan(gaps.get(f)), "fold_spread": round(float(np.std(good)), 4) if good else math.nan,
            "shadow_floor": round(S.shadow_floor(shadow), 4), "power_flag": power_flag(n.get(f, 0)), "n": n.get(f, 0),
        }
    return out


def _out_of_fold(run, rows, folds, fs, ttype, y, shadow_b) -> dict[str, dict]:
    """Columns of many levels, scored on rows whose own target wasn't used. A shadow deals the (target, fold) pairs out to the levels anew: for a
    binary target on counts (see resampling), for a number inside blocks of rows that a hash of the row key chooses."""
    binary = ttype == "binary"
    plan = I.iv_oof if binary else I.target_eta_oof
    long = categorical(rows, fs, y, ["__fold", "row_key"], nulls=not binary)
    long = keep(long.withColumnRenamed("__fold", "fold"))
    effects = {r["feature"]: r.asDict() for r in plan(long, ["feature"], folds).collect()}
    shadows: dict[str, list] = {f: [] for f in fs}
    if shadow_b and binary:
        for r in S.resample(long.drop("row_key"), dict.fromkeys(fs, "IV (oof)"), 0, shadow_b, run.frame.seed, folds=folds).collect():
            shadows[r["feature"]] = r["shadow"]
    elif shadow_b:
        for r in I.eta_of_cells(_dealt_in_blocks(long, shadow_b, run.frame.seed), ["feature", "rep"], folds).collect():
            shadows[r["feature"]].append(_nan(r["effect"]))
    out = {}
    for f in fs:
        e = effects.get(f, {})
        effect = _nan(e.get("effect"))
        n = rows.where(F.col(f).isNotNull() & y.isNotNull()).count() if not binary else e.get("n", 0)
        out[f] = {
            "column": f, "metric_name": "IV (oof)" if binary else "η² (oof)", "effect": effect, "effect_ci": (math.nan, math.nan), "p": S.permutation_p(effect, shadows[f]), "shape_gap": math.nan,
            "fold_spread": math.nan, "shadow_floor": round(S.shadow_floor(shadows[f]), 4), "power_flag": power_flag(n), "n": n,
        }
    return out


BLOCK_ROWS = 1_000_000


def _dealt_in_blocks(long: DataFrame, b: int, seed: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(feature, rep, x, fold, n, s, q): cells of b permutations of (y, fold) against x. A permutation stays inside blocks of about rows rows, drawn by a hash of the
    row key; what a real effect leaves in the means of k such blocks of n rows is k / n of it."""
    import pandas as pd

    blocks = max(1, -(-long.count() // rows))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "row_key"])
        code, levels = pd.factorize(g["x"], use_na_sentinel=False)
        y, fold = g["y"].to_numpy(float), g["fold"].to_numpy()
        k = int(fold.max()) + 1
        rng, out = np.random.default_rng([seed, key[1]]), []
        for rep in range(b):
            p = rng.permutation(len(g))
            cell, at = np.unique(code * k + fold[p], return_inverse=True)
            n, s, q = np.bincount(at), np.bincount(at, y[p]), np.bincount(at, y[p] ** 2)
            out.append(pd.DataFrame({"feature": key[0], "rep": rep, "x": levels.to_numpy(dtype=object)[cell // k], "fold": cell % k, "n": n, "s": s, "q": q}))
        return pd.concat(out)

    kind = "feature string, rep int, x string, fold int, n long, s double, q double"
    keyed = long.withColumn("y", F.col("y").cast("double")).withColumn("h", F.xxhash64("row_key", F.lit(seed))).withColumn("block", F.pmod("h", F.lit(blocks)))
    dealt = keyed.groupBy("feature", "block").applyInPandas(one, kind)
    return dealt.groupBy("feature", "rep", "x", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def _survival(run, fs, shadow_b) -> dict[str, dict]:
    """C-index of univariate Cox models; the floor is that of permuted features. Strings are groups of a log-rank test: effect is 1 - p."""
    t, e = run.frame.target, run.frame.event_col
    folds = run.guard("relevance")
    rows = run.df.join(folds.frame.where(folds.is_screened(F.col("fold"))).select("row_key"), "row_key", "left_semi")
    named = [f for f in fs if isinstance(run.df.schema[f].dataType, T.StringType)]
    if named:
        out = _survival(run, [f for f in fs if f not in named], shadow_b) if len(named) < len(fs) else {}
        for f in named:
            _, p = V.logrank(rows, t, e, f)
            n = run.df.where(F.col(f).isNotNull()).count()
            out[f] = {"column": f, "metric_name": "log-rank", "effect": 1 - p, "effect_ci": (math.nan, math.nan), "p": p, "shape_gap": math.nan, "fold_spread": math.nan, "shadow_floor": 1 - COX_P, "power_flag": power_flag(n), "n": n}
        return out
    fit = V.cox_screen(rows, t, e, fs)
    floors = _survival_floors(run, rows, fs, shadow_b)
    n = {r["feature"]: r["n"] for r in numeric(run.df, fs, number(e)).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        f: {"column": f, "metric_name": "C-index", "effect": max(c, 1 - c) if (c := fit[f]["cindex"]) == c else math.nan, "effect_ci": (math.nan, math.nan), "p": fit[f]["p"], "shape_gap": math.nan,
            "fold_spread": math.nan, "shadow_floor": round(S.shadow_floor(floors.get(f, [])), 4), "power_flag": power_flag(n.get(f, 0)), "n": n.get(f, 0)}
        for f in fs
    }


def _survival_floors(run, rows, fs, shadow_b) -> dict[str, list[float]]:
    """Under a permutation the C-index of a feature is that of the same margins on a grid of quantile bins: pairs inside a bin of x, 1 / 256 of all, count as ties, of
    which either order is as likely."""
    import pandas as pd

    t, e = number(run.frame.target), (number(run.frame.event_col) > 0).cast("int")
    ev = rows.select(*[number(f).alias(f) for f in fs], t.alias("t"), e.alias("e")).unpivot(["t", "e"], fs, "feature", "x").where("x is not null and t is not null and e is not null")
    grid = 256
    xb = S._binned(ev.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")), ["feature"], "x", "xb", grid)
    tb = S._binned(ev.groupBy("feature", "t").agg(F.count(F.lit(1)).alias("n")), ["feature"], "t", "tb", grid)
    c = ev.join(xb, ["feature", "x"]).join(tb, ["feature", "t"]).groupBy("feature", "xb", "tb", "e").agg(F.count(F.lit(1)).alias("n"))
    seed, b = run.frame.seed, shadow_b

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        xk, xi = np.unique(g["xb"].to_numpy(), return_inverse=True)
        te, yi = np.unique(g["tb"].to_numpy() * 2 + g["e"].to_numpy(), return_inverse=True)
        table = np.zeros((len(xk), len(te)), np.int64)
        np.add.at(table, (xi, yi), g["n"].to_numpy())
        found = []
        for s in S.tables(np.random.default_rng(seed), table, np.tile(table.sum(0), (b, 1)), True):
            i, j = np.nonzero(s)
            good, tie, pairs = V.count_pairs((te[j] // 2).astype(float), (te[j] % 2).astype(float), xk[i].astype(float), s[i, j])
            if pairs:
                v = (good + tie / 2) / pairs
                found.append(max(v, 1 - v))
        return pd.DataFrame([[key[0], found]])

    return {r["feature"]: r["s"] for r in c.groupBy("feature").applyInPandas(one, "feature string, s array<double>").collect()}


def decide(facts: dict, levels: int | None = None, gap: float = 0.1, spread: float = 0.1) -> tuple[str, str]:
    """(verdict, reason) of one feature. Dropped if under the shadow floor and under the metric's own floor and steady over folds;
    under one of them only, it is for a person to review; a wide shape gap calls for engineering."""
    e, name = facts.get("effect", math.nan), facts["metric_name"]
    if name == "derive-first":
        return "engineer", "datetime (derive its parts first)"
    if e != e:
        return "review", f"no effect ({name} is undefined)"
    least = cramers_v_floor(levels or 2) if name == "Cramér's V" else AUTO_DROP.get(name, 0.0)
    noise, weak = e <= facts.get("shadow_floor", math.nan), e < least
    if facts.get("shape_gap", math.nan) > gap + 0.5 * math.sqrt(10 / max(facts.get("n", 0), 1)):  # ten bins of noise have a gap, too
        return "engineer", f"not monotone (shape gap {facts['shape_gap']:.3f})"
    if noise and weak and not facts.get("fold_spread", math.nan) > spread:
        return "drop", f"under the floors ({name} {e:.4f}, shadow {facts['shadow_floor']:.4f})"
    if noise:
        return "drop" if weak or name in ("IV", "IV (oof)", "Cramér's V") else "review", f"within noise ({name} {e:.4f}, shadow {facts['shadow_floor']:.4f})"
    if weak:
        return "review", f"weak ({name} {e:.4f} under {least:g})"
    return "keep", f"signal ({name} {e:.4f} over {facts['shadow_floor']:.4f})"


def _expanded(run: Run) -> DataFrame:
    """Parts of date columns instead of them; a flag and the other values of numeric columns of which over half is 0."""
    f = run.frame
    spare = {f.target, f.event_col, f.date_col, f.reference_date, "row_key", *f.id_cols}
    df = run.df
    for c in P.looks_like_dates(df, [c for c in df.columns if c not in spare]):
        df = derive_datetime(df, c).drop(c)
    numbers = [c for c in df.columns if c not in spare and isinstance(df.schema[c].dataType, T.NumericType)]
    for r in P.distribution(df, numbers).collect() if numbers else []:
        if "zero-inflated" in r["flags"]:
            zero, rest = hurdle_split(F.col(r["column"]))
            df = df.withColumn(f"{r['column']}__zero", zero).withColumn(r["column"], rest)
    return df


def screen(run: Run, strategy: str | None = None, types: dict[str, str] | None = None, ci_b: int = 200, shadow_b: int = 50, k: int | None = None, check: bool = False, expand: bool = False) -> DataFrame:
    """Parts B to H over an opened run, to the ledger: a row for each column but the target and the row key.

    k is 5, or 3 for a small sample. With expand, date columns are replaced by their parts and columns with many zeros by a flag and their other values before the screening.
    With check, which takes far longer than the rest, columns that the random forest confirms although they were dropped go to review. The viability floors go into the report and, where one isn't met, the
    reasons of the columns."""
    if expand:
        run.df = _expanded(run)
    f = run.frame
    protected = [c for c in (f.target, f.event_col, f.date_col, f.reference_date) if c]
    found = P.viability(run.df, f.target, f.target_type, f.event_col).first().asDict()
    enough = viable(f.target_type or "binary", found["positives"], found["effective_n"] or 0)
    k = k or recommended_k(tier_for(found["effective_n"] or 0))
    base = run.df.drop("row_key")
    facts = P.profile(base)
    same = P.duplicate_columns(base)
    table = {r["column"]: r for r in facts.join(P.structural_flags(facts, protected, same), "column").join(P.semantic_types(facts), "column").collect()}
    kinds = {}
    for c in base.columns:
        r = table[c]
        if c in protected:
            continue
        if r["flag"]:
            detail = f" (of {same[c]})" if r["flag"] == "duplicate" else f" ({r['n_unique']} values, {r['missing_rate']:.0%} missing)"
            run.ledger.upsert(c, semantic_type=r["semantic_type"], verdict="structural-drop", reason=r["flag"] + detail)
            continue
        kind = (types or {}).get(c, r["semantic_type"])
        kinds[c] = "nominal" if kind in ("identifier", "constant") else kind
        run.ledger.upsert(c, semantic_type=kinds[c])
    run.leaks.extend(L.name_signals(run.spark, list(kinds), f.target))
    if f.reference_date or f.date_col:
        run.leaks.extend(L.future_timestamps(base, F.col(f.reference_date or f.date_col), protected))
    how = strategy or suggest_strategy(bool(f.id_cols), f.date_col is not None)
    run.freeze(folds_.make_folds(run.df, how, k, seed=f.seed, target=f.target, group=f.id_cols[0] if f.id_cols else None, date=f.date_col))
    if enough and f.target_type in ("binary", "multiclass"):
        enough = folds_viable([r["positives"] for r in folds_.fold_positives(run.df, run.folds, f.target).collect()])
    run.report.add("B Viability", facts=found | {"viable": enough, "folds": k})
    if f.target_type == "binary":
        y = target_column(run)
        run.leaks.extend(L.presence_signals(base, y, list(kinds)))
        run.leaks.extend(L.missingness_signals(base, y, [c for c in kinds if table[c]["missing_rate"] > 0]) if any(table[c]["missing_rate"] > 0 for c in kinds) else run.spark.createDataFrame([], L.SIGNAL))
        run.leaks.extend(L.separation(base, y, [c for c in kinds if kinds[c] != "datetime"]))
    measured = relevance(run, kinds, ci_b, shadow_b)
    effects = run.spark.createDataFrame([(c, r["metric_name"], r.get("effect")) for c, r in measured.items() if r.get("effect", math.nan) == r.get("effect", math.nan)], "column string, metric_name string, effect double")
    run.leaks.extend(L.effect_outliers(effects))
    for name, limit in LEAK_FLAG.items():
        run.leaks.extend(L.effect_backstop(effects.where(F.col("metric_name") == name), limit))
    for c, r in measured.items():
        verdict, reason = decide(r, table[c]["n_unique"])
        reason = reason if enough else f"{reason}; too few cases to be sure"
        run.ledger.upsert(c, verdict=verdict, reason=reason, **{k_: v for k_, v in r.items() if k_ not in ("column", "p", "n")})
    keeps = {c: kinds[c] for c in kinds if run.ledger.rows[c]["verdict"] == "keep"}
    if len(keeps) > 1:
        for group in R.components(R.pairwise(run.df, keeps)):
            best = R.representative(group, {c: measured[c]["effect"] for c in group}, {c: table[c]["missing_rate"] for c in group})
            for c in group:
                if c != best:
                    run.ledger.upsert(c, verdict="redundant", redundant_with=best, reason=f"redundant (with {best})")
    for c in dict.fromkeys(r[1] for r in run.leaks.rows):
        if c in run.ledger.rows:
            run.ledger.upsert(c, leak_flag="; ".join(dict.fromkeys(r[2] for r in run.leaks.for_column(c))))
    for r in L.adjudicate(run.leaks.signals(run.spark)).collect():
        if r["column"] in run.ledger.rows and run.ledger.rows[r["column"]].get("verdict") != "structural-drop":
            run.ledger.upsert(r["column"], verdict="leak-suspect", leak_flag=r["leak"], reason=f"leak suspect ({r['leak']})")
    dropped = [c for c in kinds if run.ledger.rows[c].get("verdict") == "drop"]
    if check and dropped and f.target_type != "survival":
        tried = [c for c in kinds if run.ledger.rows[c].get("verdict") in ("keep", "drop") and kinds[c] != "datetime"]
        for c, status in X.crosscheck(run.df, tried, f.target, f.target_type, f.seed).items():
            if status == "confirmed" and c in dropped:
                run.ledger.upsert(c, verdict="review", reason=f"confirmed by the cross-check; {run.ledger.rows[c]['reason']}")
    for r in rank_within_type(run.ledger.frame(run.spark)).collect():
        run.ledger.upsert(r["column"], rank_within_type=r["rank"])
    ledger = run.ledger.frame(run.spark)
    run.report.add("H Ledger", tables=[("", ledger.drop("effect_ci"))], notes=run.limits_note())
    return ledger

"""Planted columns: profile, values, folds, leaks, run mechanics, and a whole run."""

import json
import os
import random
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import crosscheck as X
from sievework.operators import folds as E
from sievework.operators import leakage as L
from sievework.operators import profile as P
from sievework.operators import redundancy as R
from sievework.operators import report as O
from sievework.plans import relevance as RL
from sievework.plans.run import LEDGER, GateFailure, Ledger, open_run, resume_run
from sievework.sources import ingest
from sievework.streaming import psi as W


@pytest.fixture(scope="module")
def planted():
    n, rng = 500, np.random.default_rng(17)
    y = rng.integers(0, 2, n)
    signal = y + rng.normal(0, 0.9, n)
    return pd.DataFrame({"customer_id": np.arange(n), "signal": signal, "noise": rng.normal(size=n), "region": rng.choice(["a", "b", "c", "d"], n), "constant": 7, "leak_score": y.astype(float), "churn": y, "signal_dup": signal})


def test_profile_and_flags(spark, planted):
    df = ingest.normalise(spark.createDataFrame(planted.assign(gap=np.where(planted.index < 490, np.nan, 1.5))))
    facts = P.profile(df)
    flags = {r["column"]: r["flag"] for r in P.structural_flags(facts, ["churn"], P.duplicate_columns(df)).collect()}
    assert flags == {"customer_id": "identifier", "signal": None, "noise": None, "region": None, "constant": "constant", "leak_score": None, "churn": None, "signal_dup": "duplicate", "gap": "constant"}
    kinds = {r["column"]: r["semantic_type"] for r in P.semantic_types(facts).collect()}
    assert (kinds["customer_id"], kinds["signal"], kinds["region"], kinds["leak_score"], kinds["constant"]) == ("identifier", "continuous", "nominal", "binary", "constant")
    assert {r["column"] for r in P.id_candidates(facts).collect()} >= {"customer_id"}


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert P.duplicate_columns(df) == {} and P.profile(df).count() == 0
    assert {r["missing"] for r in P.missingness(df).collect()} == {None}


def test_duplicates_need_the_same_type_and_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1, 2, None, None), (2, 2.0, 2, 1, 3, 3)], "a int, b double, c int, d int, e int, f int")
    assert P.duplicate_columns(df) == {"c": "a", "f": "e"}


def test_nan_is_missing(spark):
    df = ingest.normalise(spark.createDataFrame(pd.DataFrame({"x": [1.0, float("nan"), 3.0, 4.0]})))
    assert P.missingness(df).first()["missing"] == 0.25


def test_sentinels(spark):
    df = spark.createDataFrame([(-999.0, " NA ")] * 3 + [(30.0, "x")], "age double, s string")
    assert {tuple(r) for r in P.sentinel_candidates(df).collect()} == {("age", "-999", 3), ("s", "'na'", 3)}
    clean = C.null_sentinels(df, {"age": [-999.0], "s": ["na"]})
    assert clean.where("age is null").count() == 3 and clean.where("s is null").count() == 0
    assert C.null_sentinels(df, {"s": ["na"]}, trim=True).where("s is null").count() == 3


def test_distribution_matches_pandas(spark):
    x = pd.Series(np.random.default_rng(0).exponential(size=50))
    r = P.distribution(spark.createDataFrame(x.to_frame("x")), ["x"]).first()
    assert r["skew"] == round(x.skew(), 4)
    assert P.distribution(spark.createDataFrame([(2.0,)] * 5, "x double"), ["x"]).first()["skew"] == 0


def test_comissing_and_components(spark):
    df = spark.createDataFrame([(None if i < 12 else i, None if i < 12 else -i, i, None if i % 2 else i) for i in range(40)], "a int, b int, c int, d int")
    pairs = P.comissing_pairs(df)
    assert {(r["a"], r["b"]): round(r["corr"], 6) for r in pairs.collect()}[("a", "b")] == 1
    assert R.components(pairs, score="corr") == [["a", "b"]]


def test_datetime_parts(spark):
    df = spark.sql("select timestamp_ntz'2024-06-01 06:00:00' d union all select timestamp_ntz'2024-06-03 00:00:00' union all select null")
    out = C.derive_datetime(df, "d")
    assert len(out.columns) == 15
    r = {x["d__day"]: x for x in out.collect()}
    assert r[1]["d__dow"] == 5 and r[1]["d__is_weekend"] == 1 and r[1]["d__recency_days"] == 1.75 and r[3]["d__recency_days"] == 0
    assert r[None]["d__is_weekend"] == 0 and r[None]["d__month_sin"] is None and math.isclose(r[1]["d__hour_sin"], 1)


def test_hurdle(spark):
    zero, rest = C.hurdle_split(F.col("x"))
    got = spark.createDataFrame([(0,), (3,), (None,)], "x int").select(zero, rest).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (0.0, 3), (0.0, None)]


def test_folds(spark, planted):
    df = spark.createDataFrame(planted)
    f = E.make_folds(df, "stratified", key="customer_id", target="churn")
    sizes = df.join(f.frame, df["customer_id"] == F.col("row_key")).groupBy("churn", "fold").count()
    assert {r["lo"] + 1 >= r["hi"] for r in sizes.groupBy("churn").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()} == {True}
    again = E.make_folds(df.repartition(7), "stratified", key="customer_id", target="churn")
    assert f.frame.exceptAll(again.frame).count() == 0
    g = E.make_folds(df, "grouped", 4, key="customer_id", group="region")
    assert df.join(g.frame, df["customer_id"] == F.col("row_key")).groupBy("region").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    dated = df.withColumn("day", F.expr("date_add(date'2024-01-01', cast(customer_id % 90 as int))"))
    t = E.make_folds(dated, "time", 4, key="customer_id", date="day")
    ends = {r["fold"]: r for r in dated.join(t.frame, dated["customer_id"] == F.col("row_key")).groupBy("fold").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(ends[k]["hi"] <= ends[k + 1]["lo"] for k in range(4)) and all(ends[k]["n"] == 100 for k in range(1, 5))
    with pytest.raises(ValueError):
        E.make_folds(df, "time")
    assert sum(r["positives"] for r in E.fold_positives(df, f, "churn", 1, key="customer_id").collect()) == planted["churn"].sum()


def test_groups_are_dealt_as_one_by_one(spark):
    rng = random.Random(5)
    for sizes in ([100, *[1] * 60], [rng.randrange(1, 30) for _ in range(200)], [7] * 11, [3]):
        rows = [(f"{g:03d}-{i}", f"g{g:03d}") for g, n in enumerate(sizes) for i in range(n)]
        f = E.make_folds(spark.createDataFrame(rows, "row_key string, g string"), "grouped", 4, group="g").frame
        got = sorted(r["n"] for r in f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect())
        load = [0] * 4
        for n in sorted(sizes, reverse=True):
            load[load.index(min(load))] += n
        assert got == sorted(v for v in load if v) and f.join(spark.createDataFrame(rows, "row_key string, g string"), "row_key").groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_crosscheck(spark):
    rng = np.random.default_rng(5)
    cat = rng.integers(0, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"catsig": np.array(list("abc"))[cat], "noise": rng.normal(size=400), "y": (rng.random(400) < 0.2 + 0.3 * cat).astype(int)}))
    got = X.crosscheck(df, ["catsig", "noise"], "y", "binary", rounds=12, trees=30)
    assert got["catsig"] in ("confirmed", "tentative") and got["noise"] != "confirmed" and X.crosscheck(df, [], "y", "binary") == {}


def test_row_keys_must_be_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "k int, y int")
    for some in (df.where("k is not null"), df.where("y = 1")):
        with pytest.raises(ValueError, match="row key"):
            open_run(spark, some, str(tmp_path), row_key="k")


def test_expansion_of_dates_and_zeros(spark, tmp_path):
    df = spark.sql("select id, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) at, if(id % 3 = 0, double(id), 0d) amount, int(id % 2) y from range(120)")
    run = open_run(spark, df, f"file://{tmp_path}", target="y", target_type="binary", row_key="id")
    cols = RL._expanded(run).columns
    assert "at" not in cols and "at__month" in cols and "amount__zero" in cols


def test_guard(spark, planted, tmp_path):
    run = open_run(spark, spark.createDataFrame(planted), str(tmp_path), target="churn", target_type="binary", row_key="customer_id")
    with pytest.raises(GateFailure):
        RL.relevance(run, {"signal": "continuous"})


def test_gate_writes_a_card_before_it_raises(spark, planted, tmp_path):
    run = open_run(spark, spark.createDataFrame(planted), str(tmp_path), run_id="r")
    assert run.gate("B", {"enough": True})
    for given in ({"enough": False}, {}):
        with pytest.raises(GateFailure):
            run.gate("C", given)
        assert json.loads((tmp_path / "r/decision_cards/C.json").read_text())["passed"] is False


def test_open_checks_its_arguments(spark, planted, tmp_path):
    df = spark.createDataFrame(planted)
    with pytest.raises(ValueError, match="no column"):
        open_run(spark, df, str(tmp_path), target="nope")
    with pytest.raises(ValueError, match="target type"):
        open_run(spark, df, str(tmp_path), target_type="odd")


def test_ledger(spark):
    book = Ledger()
    book.upsert("a", verdict="keep", effect=0.7, note="x")
    book.upsert("a", reason="why")
    book.upsert("b", verdict="drop", reason="weak (0.1)")
    out = book.frame(spark)
    assert out.columns == [*LEDGER.names, "note"] and out.count() == 2 and book.get("a")["reason"] == "why"
    with pytest.raises(ValueError):
        book.upsert("c", verdict="maybe")
    assert {tuple(r) for r in O.drop_rate_by_rule(out).collect()} == {("weak", 1)}
    assert {r["column"]: r["rank"] for r in O.rank_within_type(out).collect()} == {"a": 1, "b": 2}


def test_checkpoint_and_resume(spark, planted, tmp_path):
    run = open_run(spark, spark.createDataFrame(planted), str(tmp_path), run_id="r", target="churn", target_type="binary", row_key="customer_id", id_cols=["customer_id"])
    run.df = C.null_sentinels(run.df, {"constant": [7]})
    run.ledger.upsert("constant", verdict="structural-drop", reason="constant")
    run.leaks.add("C", "leak_score", "target-like-name", "direct")
    run.report.add("A", body="hello", notes="two\nlines")
    run.freeze(E.make_folds(run.df, "stratified", target="churn"))
    run.checkpoint("D")
    back = resume_run(spark, "r", str(tmp_path))
    assert back.df.where("constant is not null").count() == 0 and back.frame == run.frame and back.folds.k == 5
    assert back.ledger.get("constant")["reason"] == "constant" and len(back.leaks) == 1 and "> two" in back.report.text()
    back.report.add("A", body="anew")
    assert "hello" not in back.report.text() and os.path.exists(back.report.export_html())
    assert run.manifest()["seed"] == 42 and run.log(str(tmp_path / "log.jsonl"))["rules"] == {"constant": 1}
    assert spark.read.parquet(run.save_ledger()).count() == spark.read.option("header", True).csv(run.save_ledger("l.csv")).count() == 1
    with pytest.raises(FileNotFoundError):
        resume_run(spark, "other", str(tmp_path))


def test_leaks(spark):
    df = spark.sql("select id, int(id % 2) y, case when id % 2 = 1 then 1.0 end receipt, case when id % 2 = 1 or id < 20 then 1.0 end opt, timestamp_ntz'2024-01-01' at, timestamp_ntz'2024-02-01' done, '2023-01-01' old from range(400)")
    y = F.col("y")
    got = lambda t: {r["column"]: r["detector"] for r in t.collect()}
    assert got(L.presence_signals(df, y, ["receipt", "opt", "id"])) == {"receipt": "present-only-for-one-class"}
    assert got(L.missingness_signals(df, y, ["receipt", "opt"])).keys() == {"receipt", "opt"}
    assert got(L.future_timestamps(df, F.col("at"), ["at"])) == {"done": "future-timestamp"}
    assert got(L.separation(df.withColumn("s", F.concat(F.lit("k"), y)), y, ["s", "id"])) == {"s": "perfect-separation"}
    assert got(L.name_signals(spark, ["y", "risk_score", "target"], "target")) == {"risk_score": "target-like-name"}


def test_adjudication_needs_strength_or_company(spark):
    rows = [("F", "a", "effect-above-backstop", "direct", "", 0), ("F", "b", "effect-above-backstop", "direct", "", 1), ("F", "b", "outlier-effect-vs-peers", "direct", "", 2), ("C", "c", "target-like-name", "direct", "", 3)]
    out = {r["column"]: r["leak"] for r in L.adjudicate(spark.createDataFrame(rows, L.SIGNAL + ", seq int")).collect()}
    assert out == {"b": "effect-above-backstop:direct (+1)", "c": "target-like-name:direct"}


def test_string_ordinal_scores_zero(spark):
    df = spark.createDataFrame([("m", 1.0, "p"), ("y", 2.0, "q")] * 20, "contract string, x double, s string")
    scores = {(r["a"], r["b"]): r["score"] for r in R.pairwise(df, {"contract": "ordinal", "x": "continuous", "s": "nominal"}).collect()}
    assert scores[("contract", "x")] == 0 and scores[("contract", "s")] == 0 and scores[("s", "x")] == 1
    assert R.representative(["b", "a"], {"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.1}) == "a"


@pytest.mark.parametrize(("kind", "ttype", "name"), [("count", "binary", "AUC"), ("ordinal", "binary", "IV"), ("continuous", "multiclass", "KW ε²"), ("nominal", "multiclass", "Cramér's V"), ("ordinal", "ordinal", "Spearman ρ"), ("binary", "ordinal", "Cliff's δ"), ("binary", "regression", "point-biserial"), ("nominal", "regression", "η²"), ("count", "survival", "C-index"), ("datetime", "binary", "derive-first")])
def test_dispatch(kind, ttype, name):
    assert RL.metric_for(kind, ttype).name == name


def test_dispatch_of_unknown_types():
    with pytest.raises(ValueError):
        RL.metric_for("constant", "binary")


def test_relevance_of_other_targets(spark, planted, tmp_path):
    rng = np.random.default_rng(9)
    more = planted.assign(grade=np.digitize(planted["signal"], [0, 1]).astype(float), amount=planted["signal"] * 3 + rng.normal(size=500), days=np.ceil(rng.exponential(20 / (1 + planted["churn"]))), many=[f"k{i % 120}" for i in range(500)], cls=np.where(planted["signal"] > 0.5, "p", "q"))
    df = spark.createDataFrame(more)
    cases = [("ordinal", "grade", {"signal": "continuous", "churn": "binary", "region": "nominal"}), ("regression", "amount", {"signal": "continuous", "churn": "binary", "region": "nominal", "many": "high_card"}), ("multiclass", "cls", {"signal": "continuous", "region": "nominal"}), ("binary", "churn", {"many": "high_card"})]
    for ttype, target, features in cases:
        run = open_run(spark, df, str(tmp_path), target=target, target_type=ttype, row_key="customer_id")
        run.freeze(E.make_folds(run.df, "plain", 3))
        got = RL.relevance(run, features, ci_b=20, shadow_b=10)
        if "signal" in features:
            assert got["signal"]["effect"] > got["signal"]["shadow_floor"] and got["signal"]["q_value"] < 0.2, (ttype, got["signal"])
        if "many" in features:
            assert got["many"]["effect"] < 0.3 and got["many"]["metric_name"].endswith("(oof)")
    run = open_run(spark, df, str(tmp_path), target="days", target_type="survival", event_col="constant", row_key="customer_id")
    run.freeze(E.make_folds(run.df, "plain", 3))
    got = RL.relevance(run, {"signal": "continuous"}, shadow_b=10)["signal"]
    assert got["metric_name"] == "C-index" and got["effect"] > got["shadow_floor"]
    got = RL.relevance(run, {"region": "nominal", "signal": "continuous"}, shadow_b=5)
    assert got["region"]["metric_name"] == "log-rank" and 0 <= got["region"]["p"] <= 1 and got["signal"]["metric_name"] == "C-index"


def test_small_sample_is_flagged(spark, tmp_path):
    rng = np.random.default_rng(1)
    run = open_run(spark, spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=60), "y": rng.integers(0, 2, 60)})), str(tmp_path), target="y", target_type="binary")
    run.freeze(E.make_folds(run.df, "stratified", 3, target="y"))
    assert RL.relevance(run, {"x": "continuous"}, ci_b=0, shadow_b=5)["x"]["power_flag"] == "reduced-power"


def test_whole_run(spark, planted, tmp_path):
    run = open_run(spark, spark.createDataFrame(planted), str(tmp_path), target="churn", target_type="binary", row_key="customer_id")
    verdicts = {r["column"]: r["verdict"] for r in RL.screen(run, "stratified", ci_b=50, shadow_b=50).collect()}
    assert verdicts == {"customer_id": "structural-drop", "signal": "keep", "noise": "drop", "region": "drop", "constant": "structural-drop", "leak_score": "leak-suspect", "signal_dup": "structural-drop"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("name,n\ncafé,1\n", "utf-8")
    (tmp_path / "c.tsv").write_text("name\tn\nx\t1\n")
    assert ingest.read(spark, f"{tmp_path}/a.csv").first()["name"] == ingest.read(spark, f"{tmp_path}/b.csv").first()["name"] == "café"
    assert ingest.read(spark, f"{tmp_path}/c.tsv").columns == ["name", "n"]
    spark.range(3).write.parquet(f"{tmp_path}/d.PARQUET")
    assert ingest.read(spark, f"{tmp_path}/d.PARQUET").count() == 3


def test_row_keys_of_equal_rows_differ(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert ingest.with_row_key(df).select("row_key").distinct().count() == 3


def test_stream_of_drift(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 4), 0, 0, id / 1000) ts, double(id % 100) + if(id % 4 = 1, 60, 0) value from range(12000)").repartition(1).write.parquet(src)
    ref = spark.sql("select double(id % 100) value from range(1000)")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(src)
    q = W.watch(stream, ref, "value", "ts", f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    got = {str(r["start"])[:10]: r["psi"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01"] < 0.1 < 0.25 < got["2024-01-02"]


def test_forest_of_the_crosscheck_counts_rows_in_numpy_blocks(spark, monkeypatch):
    """Splits of all trees are those of a plain search over the same drawn rows, in any number of blocks."""
    monkeypatch.setattr(X, "LEAST", 100)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (2, 350)).astype(float)
    y = (rng.random(350) < 0.2 + 0.1 * x[0]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "x0": x[0], "x1": x[1]}))
    blocks = X._blocks(df, ["x0", "x1"], 1, 100)
    got = X._importances(blocks, 4, [0, 1], [0, 1], [3], 4, 1, 2, 0.5, 1)[3]
    want, columns, labels, weights = np.zeros(4), [], [], []
    for r in blocks.orderBy("block").collect():
        bins = np.frombuffer(r["x"], np.uint8).reshape(2, -1)
        g = np.random.default_rng([1, 3, 0, r["block"]])
        columns.append(np.vstack([bins, *[bins[i][g.permutation(bins.shape[1])][None] for i in (0, 1)]]))
        labels.append(np.frombuffer(r["y"]))
        weights.append(np.stack([X._weights([1, 3, 2, t, r["block"]], bins.shape[1]) for t in range(4)]))
    c, label, w = np.concatenate(columns, 1), np.concatenate(labels), np.concatenate(weights, 1)
    gini = lambda v, on: (n := v[on].sum()) and n * (1 - sum((v[on & (label == k)].sum() / n) ** 2 for k in (0, 1)))
    for t, subset in enumerate(X._subsets([1, 3, 1, 0, 0], 4, 1, 4)[:, 0]):
        gains = {(f, cut): gini(w[t].astype(float), np.ones(350, bool)) - gini(w[t].astype(float), c[f] <= cut) - gini(w[t].astype(float), c[f] > cut) for f in subset for cut in range(5)}
        want[max(gains, key=gains.get)[0]] += 1
    assert len(label) == 350 and blocks.count() == 4 and np.allclose(got, want)


def test_crosscheck_of_numbers_and_many_classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "noise": rng.normal(size=600), "y": x + rng.normal(size=600), "c": [f"{v:02d}" for v in np.clip(x * 6 + 12, 0, 24).astype(int)]}))
    for y, kind in (("y", "regression"), ("c", "multiclass")):
        got = X.crosscheck(df, ["x", "noise"], y, kind, rounds=7, trees=10)
        assert got["x"] == "confirmed" and got["noise"] != "confirmed"

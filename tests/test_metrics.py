"""Known values and properties of the metric operators, against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import tails, thresholds
from sievework.operators import association as A
from sievework.operators import drift as D
from sievework.operators import folds as E
from sievework.operators import information as I
from sievework.operators import profile as P
from sievework.operators import resampling as S
from sievework.operators import survival as V
from sievework.operators.longform import categorical, numeric


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def effect(plan, spark, x, y, cat=False, col="effect"):
    df = frame(spark, x=x, y=y)
    long = categorical(df, ["x"], F.col("y")) if cat else numeric(df, ["x"], F.col("y"))
    return plan(long, ["feature"]).first()[col]


def brute_auc(x, y):
    p, q = x[y == 1][:, None], x[y == 0][None, :]
    return ((p > q) + 0.5 * (p == q)).mean()


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 400).astype(float)
    y = (rng.random(400) < 0.15 + 0.02 * x).astype(int)
    return x, y


def test_auc_has_no_sign_and_counts_ties(spark, sample):
    x, y = sample
    a = brute_auc(x, y)
    assert effect(A.auc, spark, x, y) == pytest.approx(max(a, 1 - a))
    assert effect(A.auc, spark, -x, y) == pytest.approx(max(a, 1 - a))
    assert effect(A.cliffs_delta, spark, x, y) == pytest.approx(2 * a - 1)


def test_auc_of_one_class_is_null(spark):
    assert effect(A.auc, spark, [1.0, 2.0], [1, 1]) is None


def test_ranks_do_not_depend_on_partitions(spark, sample):
    x, y = sample
    before = effect(A.auc, spark, x, y)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert effect(A.auc, spark, x, y) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_correlations(spark, sample):
    x, _ = sample
    y = np.round(x / 5 + np.random.default_rng(1).normal(size=len(x)), 1)
    s = pd.DataFrame({"x": x, "y": y})
    assert effect(A.spearman, spark, x, y, col="r") == pytest.approx(s["x"].rank().corr(s["y"].rank()))
    assert effect(A.pearson, spark, x, y, col="r") == pytest.approx(s["x"].corr(s["y"]))
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert effect(A.kendall, spark, x, y) == pytest.approx((dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum()))


def test_constant_has_no_correlation(spark):
    assert effect(A.spearman, spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0], col="r") is None
    assert effect(A.pearson, spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0], col="r") is None


def test_eta_squared(spark):
    assert effect(A.eta_squared, spark, ["a", "a", "b", "b"], [1.0, 1.0, 9.0, 9.0], cat=True) == 1
    assert effect(A.eta_squared, spark, ["a", "a", "b", "b"], [5.0] * 4, cat=True) == 0


def test_bergsma_of_noise_and_copy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.choice(list("abcd"), 2000), rng.choice(list("xyz"), 2000)
    assert effect(A.bergsma_v, spark, a, b, cat=True) < 0.06
    assert effect(A.bergsma_v, spark, a, a, cat=True) > 0.95
    assert effect(A.bergsma_v, spark, ["a"] * 4, list("wxyz"), cat=True) is None


def test_tails():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(0.5, 4) == pytest.approx(0.97350098, abs=1e-8)
    assert tails.correlation_p(1.0, 10) == 0 and math.isnan(tails.correlation_p(0.5, 2))


def test_iv_needs_two_classes_and_merging_does_not_raise_it(spark):
    rng = np.random.default_rng(0)
    x, y = rng.choice(list("abcdefgh"), 800), rng.integers(0, 2, 800)
    assert effect(I.information_value, spark, x, np.ones(800, int), cat=True) is None
    each = effect(I.information_value, spark, x, y, cat=True)
    merged = effect(lambda t, by: I.information_value(t, by, binning="merge"), spark, x, y, cat=True)
    assert 0 <= merged <= each + 1e-3


def test_out_of_fold_strips_inflation(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, k=np.arange(1000), x=rng.integers(0, 250, 1000).astype(str), y=rng.integers(0, 2, 1000), v=rng.normal(size=1000))
    f = E.make_folds(df, "stratified", key="k", target="y")
    j = df.join(f.frame, df["k"] == F.col("row_key"))
    inside = I.information_value(categorical(df, ["x"], F.col("y")), ["feature"]).first()["effect"]
    outside = I.iv_oof(categorical(j, ["x"], F.col("y"), ["fold"]), ["feature"], f).first()["effect"]
    assert inside > 0.3 and outside < 0.1
    assert I.target_eta_oof(categorical(j, ["x"], F.col("v"), ["fold"], nulls=True), ["feature"], f).first()["effect"] == 0


def test_u_shape_has_a_gap(spark):
    x = np.random.default_rng(0).uniform(-3, 3, 800)
    y = (abs(x) > 1.5).astype(int)
    assert effect(A.auc, spark, x, y) < 0.6
    assert effect(I.shape_gap, spark, x, y, col="gap") > 0.1


def test_bh_is_monotone_and_passes_nulls(spark):
    t = spark.createDataFrame([(0.001,), (0.01,), (0.5,), (0.9,), (None,)], "p double")
    q = [r["q"] for r in S.bh_fdr(t).orderBy(F.col("p").asc_nulls_last()).collect()]
    assert q == [pytest.approx(0.004), pytest.approx(0.02), pytest.approx(2 / 3), pytest.approx(0.9), None]


def test_permutation_p_and_floor():
    assert S.permutation_p(9.0, np.zeros(50)) == pytest.approx(1 / 51)
    assert math.isnan(S.permutation_p(float("nan"), np.zeros(5)))
    assert S.shadow_floor([float("nan"), 0.0, 1.0], 0.5) == 0.5


def test_resampling_brackets_the_effect(spark, sample):
    x, y = sample
    long = numeric(frame(spark, x=x, y=y), ["x"], F.col("y"))
    r = S.resample(long, {"x": "AUC"}, 200, 50).first()
    a = brute_auc(x, y)
    assert r["ci_lo"] < max(a, 1 - a) < r["ci_hi"] and max(r["shadow"]) < max(a, 1 - a) and min(r["shadow"]) >= 0.5


def test_table_metrics_equal_the_plans(spark, sample):
    x, y = sample
    t = pd.crosstab(x, y).to_numpy()
    xv, yv = np.unique(x), np.array([0.0, 1.0])
    for name, plan, cat in (("AUC", A.auc, False), ("KW ε²", A.kruskal, False), ("IV", I.information_value, True), ("Cramér's V", A.bergsma_v, True), ("Spearman ρ", A.spearman, False), ("point-biserial", A.pearson, False), ("η²", A.eta_squared, True)):
        got = S.of_table(name, t.T, yv, xv) if name in S.TURNED else S.of_table(name, t, xv, yv)
        assert got == pytest.approx(effect(plan, spark, x, y, cat)), name


def test_replicates_of_tables(monkeypatch):
    """Both ways of drawing a block: margins of permutations, means and variances of both."""
    t = np.array([[30, 50, 3], [20, 0, 5], [70, 10, 1], [4, 4, 4]])
    n, rows, cols = t.sum(), t.sum(1), t.sum(0)
    for limit in (1 << 22, 10):
        monkeypatch.setattr(S, "ROWS", limit)
        want = np.tile(cols, (3000, 1))
        got = np.array(list(S.tables(np.random.default_rng(0), t, want, True)))
        assert (got.sum(1) == cols).all() and (got.sum(2) == rows).all() and (got >= 0).all()
        mean = np.outer(rows, cols) / n
        assert got.mean(0) == pytest.approx(mean, abs=0.3)
        assert got.var(0) == pytest.approx(mean * (n - rows[:, None]) * (n - cols) / n / (n - 1), rel=0.15)
        boot = np.array(list(S.tables(np.random.default_rng(1), t, want, False)))
        assert (boot.sum(1) == cols).all() and boot.mean(0) == pytest.approx(t, abs=0.4) and boot.var(0) == pytest.approx(t * (1 - t / cols), rel=0.15, abs=1e-9)


def test_hypergeometric_draws_of_any_size():
    rng = np.random.default_rng(3)
    few = S._large(rng, np.full(40_000, 7), np.full(40_000, 30), np.full(40_000, 15))
    p = np.array([math.comb(7, k) * math.comb(30, 15 - k) / math.comb(37, 15) for k in range(8)])
    assert np.bincount(few, minlength=8) / 40_000 == pytest.approx(p, abs=0.008)
    for good, bad, sample in ((6e8, 3e8, 5e8), (8e8, 3e8, 5e8), (9e11, 3e12, 1e12), (50, 4e9, 1e9), (4e9, 50, 3e9), (2e9, 2e9, 6), (3e9, 1e9, 4e9 - 5)):
        got = S.hypergeometric(rng, np.full(20_000, int(good)), int(bad), int(sample)).astype(float)
        total = good + bad
        var = sample * good / total * bad / total * (total - sample) / (total - 1)
        assert got.mean() == pytest.approx(sample * good / total, abs=4 * (var / 20_000) ** 0.5 + 1e-9) and got.var() == pytest.approx(var, rel=0.06)
        assert (got >= max(0, sample - bad)).all() and (got <= min(good, sample)).all()


def test_permuted_cells_just_below_and_above_a_billion_rows():
    """The spread of a cell goes on smoothly, and margins hold, on a skewed table too."""
    for n in (0.9e9, 1.1e9):
        for t in (np.full((2, 2), int(n / 4)), np.array([[int(n * 0.001), int(n * 0.199)], [int(n * 0.0005), int(n * 0.7995)]])):
            rows, cols = t.sum(1), t.sum(0)
            got = np.array(list(S.tables(np.random.default_rng(1), t, np.tile(cols, (1500, 1)), True)))
            assert (got.sum(1) == cols).all() and (got.sum(2) == rows).all()
            sd = (rows[0] / n * rows[1] / n * cols[0] * (cols[1] / n) * n / (t.sum() - 1)) ** 0.5
            assert got[:, 0, 0].std() == pytest.approx(sd, rel=0.07)


def test_blocks_don_t_change_the_distribution(spark):
    """Replicates of all metrics in one block and in many, against row-wise numpy."""
    rng = np.random.default_rng(12)
    n = 400
    x, y = np.round(rng.normal(size=n), 1), (rng.random(n) < 0.4).astype(int)
    heavy, cat = np.round(np.exp(rng.normal(0, 1.5, n)), 1), rng.integers(0, 4, n)
    cases = {"AUC": (x, y), "KW ε²": (x, cat), "IV": (np.round(x).astype(int).astype(str), y), "Cramér's V": (np.round(x).astype(int).astype(str), cat), "point-biserial": (y.astype(float), heavy), "η²": (cat.astype(str), heavy), "Cliff's δ": (y.astype(str), heavy), "Spearman ρ": (x, heavy)}
    plans = {"AUC": A.auc, "KW ε²": A.kruskal, "IV": I.information_value, "Cramér's V": A.bergsma_v, "Spearman ρ": A.spearman}
    for name, (a, b) in cases.items():
        df = spark.createDataFrame(pd.DataFrame({"feature": "f", "x": a, "y": b}))
        (ua, ia), (ub, ib) = (np.unique(v, return_inverse=True) for v in (a, b))

        def metric(i, j, name=name, ua=ua, ub=ub, ia=ia, ib=ib):
            t = np.zeros((len(ua), len(ub)), int)
            np.add.at(t, (ia[i], ib[j]), 1)
            return S.of_table(name, t.T, ub, np.arange(len(ua)) if ua.dtype.kind in "UO" else ua) if name in S.TURNED else S.of_table(name, t, np.arange(len(ua)), ub)

        every = np.arange(n)
        if name in plans:
            assert metric(every, every) == pytest.approx(plans[name](df, ["feature"]).first()["effect"])
        want = np.array([metric(every, rng.permutation(n)) for _ in range(600)])
        boot = np.array([metric(i, i) for i in (rng.integers(0, n, n) for _ in range(600))])
        for block in (50_000, 17) if name == "AUC" else (17,):
            r = S.resample(df, {"f": name}, 600, 600, block=block).first()
            shadow = np.array(r["shadow"])
            spread = want.std() + 1e-9
            assert abs(shadow.mean() - want.mean()) < 0.25 * spread and shadow.std() == pytest.approx(want.std(), rel=0.2), name
            for end, q in (("ci_lo", 0.025), ("ci_hi", 0.975)):
                assert abs(r[end] - np.quantile(boot, q)) < 0.8 * boot.std(), (name, end)
    df = spark.createDataFrame(pd.DataFrame({"feature": "f", "x": x, "y": y}))
    again = S.resample(df.repartition(7), {"f": "AUC"}, 20, 20, block=17).first()  # whatever the partitions
    assert again["shadow"] == S.resample(df, {"f": "AUC"}, 20, 20, block=17).first()["shadow"]


def test_a_function_as_metric(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"feature": "f", "x": x, "y": 2 * x + rng.normal(size=300)}))
    r = S.resample(df, {"f": lambda a, b: abs(np.corrcoef(a, b)[0, 1])}, 100, 50).first()
    effect = abs(np.corrcoef(*df.toPandas()[["x", "y"]].to_numpy().T)[0, 1])
    assert r["ci_lo"] < effect < r["ci_hi"] and max(r["shadow"]) < 0.3 and len(r["shadow"]) == 50


def test_psi(spark):
    rng = np.random.default_rng(0)
    a, b = frame(spark, x=rng.normal(size=1000)), frame(spark, x=rng.normal(2, 1, 1000))
    assert D.psi(a, a, "x").first()["psi"] == 0
    assert D.psi(a, b, "x").first()["psi"] > thresholds.PSI_DRIFT
    assert D.psi(a, b.where("x > 99"), "x").first()["psi"] is None


def test_vif(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    v = D.vif(frame(spark, a=x, b=x + 0.01 * rng.normal(size=500), c=rng.normal(size=500)), ["a", "b", "c"])
    assert v["a"] > 10 and v["b"] > 10 and v["c"] < 1.1


def brute_cindex(t, e, x):
    good = pairs = 0.0
    for i in range(len(t)):
        if e[i]:
            later = (t > t[i]) | ((t == t[i]) & (e == 0))
            pairs += later.sum()
            good += (x[later] < x[i]).sum() + 0.5 * (x[later] == x[i]).sum()
    return good / pairs


def test_survival(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300).round(1)
    t = np.ceil(rng.exponential(np.exp(-0.8 * x)) * 5)
    e = (rng.random(300) < 0.8).astype(int)
    df = frame(spark, t=t, e=e, x=x, g=np.where(x > 0, "hi", "lo"), z=rng.choice(["u", "v"], 300))
    assert V.concordance(df, "t", "e", ["x"]).first()["cindex"] == pytest.approx(brute_cindex(t, e, x))
    fit = V.cox_screen(df, "t", "e", ["x"])["x"]
    assert 0.5 < fit["beta"] < 1.1 and fit["p"] < 1e-6 and fit["cindex"] > 0.6
    assert V.logrank(df, "t", "e", "g")[1] < 1e-6 < V.logrank(df, "t", "e", "z")[1]


def test_cox_of_untied_times_is_the_same_by_either_rule(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, t=rng.permutation(60).astype(float), e=np.ones(60), x=rng.normal(size=60))
    a, b = (V.cox_screen(df, "t", "e", ["x"], efron=k)["x"]["beta"] for k in (True, False))
    assert a == pytest.approx(b)


def test_thresholds():
    assert pytest.approx(0.05) == thresholds.cramers_v_floor(2) and math.isnan(thresholds.cramers_v_floor(1))
    assert [thresholds.tier_for(n) for n in (100, 30, 29)] == ["full", "reduced-power", "structural-only"]
    assert not thresholds.folds_viable([]) and not thresholds.folds_viable([20, 9]) and thresholds.folds_viable([10, 11])
    assert thresholds.viable("regression", None, 100) and not thresholds.viable("binary", 49, 500)


def test_binary_target(spark):
    df = frame(spark, t=["No", "Yes", None])
    assert [r[0] for r in df.select(P.binary01(df, "t")).collect()] == [0, 1, None]
    with pytest.raises(ValueError, match="3 classes"):
        P.binary01(frame(spark, t=["a", "b", "c"]), "t")


def test_draws_of_few_items_do_not_go_row_by_row():
    t = np.array([[300_000, 100_000], [200_000, 200_000], [1, 0]])

    class Counts:
        """A generator that can't shuffle or draw rows."""

        def __init__(self, seed):
            rng = np.random.default_rng(seed)
            self.hypergeometric, self.multinomial = rng.hypergeometric, rng.multinomial

    want = np.tile(t.sum(0), (200, 1))
    dealt = np.array(list(S.tables(Counts(1), t, want, True)))
    assert (dealt.sum(1) == t.sum(0)).all() and (dealt.sum(2) == t.sum(1)).all()
    n, k, good = t.sum(), t.sum(1)[0], t.sum(0)[1]
    sd = (k * good / n * (1 - good / n) * (n - k) / (n - 1)) ** 0.5
    assert abs(dealt[:, 0, 1].mean() - k * good / n) < 4 * sd / 200**0.5 and 0.8 < dealt[:, 0, 1].std() / sd < 1.2
    drawn = np.array(list(S.tables(Counts(2), t, want, False)))
    assert (drawn.sum(1) == t.sum(0)).all() and 0.8 < drawn[:, 0, 0].std() / (500_001 * 0.6 * 0.4) ** 0.5 < 1.2


def test_few_blocks_are_drawn_by_many_tasks():
    assert S._spread(2, 17, 8) == (16, 32) and S._spread(1, 4, 8) == (4, 4) and S._spread(1000, 17, 8) == (1, 250) and S._spread(0, 17, 8) == (17, 1)

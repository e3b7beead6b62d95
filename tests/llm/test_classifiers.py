import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose, table

from sievework.llm import docstats, factorization, rules, toxicity


def auc(score, y):
    p, q = score[y == 1][:, None], score[y == 0][None, :]
    return ((p > q) + 0.5 * (p == q)).mean()


@pytest.fixture(scope="module")
def judged(spark):
    """Bad documents repeat lines and are full of symbols, toxic ones hold a few bad words; 300 are labelled and 300 held out."""
    rng = random.Random(3)
    rows, bad, toxic = [], {}, {}
    for i in range(600):
        bad[i], toxic[i] = int(i % 4 == 0), int(i % 5 == 0)
        t = prose(i, rng.randrange(30, 300))
        if bad[i]:
            t = "\n".join([t[:60] + " $$$ !!! |"] * 8)
        if toxic[i]:
            w = t.split(" ")
            for _ in range(max(2, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "slurmo", "vexhate", "grobniks"]))
            t = " ".join(w)
        rows.append((i, t))
    labels = spark.createDataFrame([(i, 1 - bad[i], toxic[i]) for i in range(300)], "doc_id long, quality int, toxic int")
    return table(spark, rows), labels, bad, toxic


def held_out(df, column, truth):
    got = df.where("doc_id >= 300").toPandas()
    return auc(got[column].to_numpy(), np.array([truth[d] for d in got["doc_id"]]))


def test_factorization_on_held_out_documents(spark, judged):
    docs, labels, bad, _ = judged
    out = factorization.classify(spark, docs, labels)
    assert held_out(out.selectExpr("doc_id", "1 - p_quality p"), "p", bad) > 0.97 and out.count() == 600


def test_rules_on_held_out_documents(spark, judged):
    docs, labels, bad, _ = judged
    assert held_out(rules.quality(spark, docs, labels).selectExpr("doc_id", "1 - p_quality p"), "p", bad) > 0.97


def test_toxicity_on_held_out_documents(spark, judged):
    docs, labels, _, toxic = judged
    out = toxicity.severity(spark, docs, labels)
    assert held_out(out, "expected_severity", toxic) > 0.97
    got = out.toPandas()
    truth = np.array([toxic[d] for d in got["doc_id"]])
    assert (got["rejected"] == (truth == 1)).mean() > 0.97
    kept = {r["doc_id"] for r in toxicity.reject_toxic(spark, docs, labels).collect()}
    assert kept == set(got.loc[~got["rejected"], "doc_id"])


def test_pair_sum_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    x = factorization.Rows(np.array([0, 3, 4, 9]), rng.integers(0, 20, 9), rng.normal(size=9))
    v = rng.normal(size=(20, 4))
    want = [sum(v[x.key[i]] @ v[x.key[j]] * x.value[i] * x.value[j] for i in range(a, b) for j in range(i + 1, b)) for a, b in zip(x.lo[:-1], x.lo[1:], strict=True)]
    assert factorization.pairs(v, x) == pytest.approx(want)


def test_trees_are_monotonic_and_flat_scoring_is_that_of_the_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=800)) > 0).astype(float)
    up = rules.fit_trees(x, y, np.array([1, 0, -1]), trees=40)
    assert auc(up.score(x), y.astype(int)) > 0.93
    for f, sign in ((0, 1), (2, -1)):
        for row in x[:40]:
            line = np.tile(row, (50, 1))
            line[:, f] = np.linspace(-3, 3, 50)
            assert (np.diff(up.score(line)) * sign >= -1e-12).all()

    def walk(t, row, k=0):
        return up.value[t, k] if up.feature[t, k] < 0 else walk(t, row, 2 * k + (1 if row[up.feature[t, k]] <= up.cut[t, k] else 2))

    assert up.score(x[:20]) == pytest.approx([up.base + sum(walk(t, r) for t in range(40)) for r in x[:20]])


def test_thresholds_are_ordered_and_share_weights():
    rng = np.random.default_rng(2)
    z = rng.normal(size=1500)
    grade = np.digitize(2 * z + rng.logistic(size=1500), [0, 1.5, 3])
    w, theta = toxicity.fit_ordinal(np.arange(1500), np.zeros(1500, int), z, grade, 1)
    assert (np.diff(theta) > 0).all() and w[0] == pytest.approx(2, abs=0.4) and theta == pytest.approx([0, 1.5, 3], abs=0.5)


def ordinal_loss(w, theta, x, grade, l2=2e-4):
    """The penalised likelihood by plain loops."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        s = sum(a * b for a, b in zip(w, row, strict=True))
        below = lambda k: 1.0 if k >= len(theta) else 0.0 if k < 0 else 1 / (1 + math.exp(s - theta[k]))  # noqa: E731, B023
        total -= math.log(below(g) - below(g - 1))
    return total / len(grade) + l2 / 2 * sum(a * a for a in w)


def test_the_ordinal_fit_is_the_least_of_the_plain_likelihood():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    grade = np.digitize(x @ [1.5, -1, 0] + rng.logistic(size=120), [0, 1.2, 2.5])
    doc, key = np.repeat(np.arange(120), 3), np.tile(np.arange(3), 120)
    w, theta = toxicity.fit_ordinal(doc, key, x.ravel(), grade, 3, steps=3000, rate=0.02)
    best = ordinal_loss(w, theta, x, grade)
    for k in range(6):
        for step in (-0.05, 0.05):
            v, t = w.copy(), theta.copy()
            (v if k < 3 else t)[k % 3] += step
            assert ordinal_loss(v, t, x, grade) > best


def test_severity_is_that_of_the_plain_formulas(spark, judged):
    docs, labels, _, _ = judged
    m = toxicity.fit(spark, docs, labels)
    some = docs.where("doc_id < 40").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in toxicity.severity(spark, docs.where("doc_id < 40"), spark.createDataFrame([], labels.schema)).collect()}
    assert len({r["expected_severity"] for r in got.values()}) == 1  # no labels
    rows = docs.where("doc_id < 40").select("doc_id", toxicity.scorer(spark, m)(docs["text"]).alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in rows}
    for r in some:
        count = {}
        _, keys, _ = toxicity.slots_of(pa.array([r["text"]]))
        for k in keys.tolist():
            if m.slot[k]:
                count[m.slot[k] - 1] = count.get(m.slot[k] - 1, 0) + 1
        s = sum(m.weight[k] * math.log1p(n) for k, n in count.items())
        above = [1 - 1 / (1 + math.exp(s - t)) for t in m.theta]
        each = [1 - above[0], *[a - b for a, b in zip(above, [*above[1:], 0.0], strict=True)]]
        assert got[r["doc_id"]]["expected_severity"] == pytest.approx(sum(above)) and got[r["doc_id"]]["p_toxic"] == pytest.approx(above[0])
        assert each[got[r["doc_id"]]["grade"]] == pytest.approx(max(each))


def test_severity_grows_with_the_share_of_bad_words(spark, judged):
    docs, labels, _, _ = judged
    levels = [f"{prose(7000 + i, 100)} " + "grobnik slurmo vexhate " * k for i in range(10) for k in (0, 2, 6, 20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(levels)], "doc_id long, text string")
    s = rows.select("doc_id", toxicity.scorer(spark, toxicity.fit(spark, docs, labels))(rows["text"])["expected_severity"].alias("s")).toPandas().sort_values("doc_id")["s"].to_numpy().reshape(10, 4)
    assert (np.diff(s, axis=1) > 0).mean() > 0.9


def test_the_first_tree_makes_the_splits_of_a_plain_search():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 0] - x[:, 1] + rng.normal(0, 4, 300)) > 0).astype(float)
    monotone = np.array([1, -1, 0])
    fitted = rules.fit_trees(x, y, monotone, trees=1)
    p = 1 / (1 + math.exp(-fitted.base))
    loss = lambda g, h, v: g * v + 0.5 * (h + rules.L2) * v * v

    def check(k, rows, lo, hi, depth):
        g, h = [(p - y[i]) for i in rows], [p * (1 - p)] * len(rows)
        clip = lambda v: min(max(v, lo), hi)
        value = clip(-sum(g) / (sum(h) + rules.L2))
        best = None
        for f in range(3):
            for cut in sorted({x[i, f] for i in rows}):
                left = [n for n, i in enumerate(rows) if x[i, f] <= cut]
                right = [n for n, i in enumerate(rows) if x[i, f] > cut]
                if min(len(left), len(right)) < rules.LEAF or depth == rules.DEPTH or len(rows) < 2 * rules.LEAF:
                    continue
                gl, hl, gr, hr = sum(g[n] for n in left), sum(h[n] for n in left), sum(g[n] for n in right), sum(h[n] for n in right)
                vl, vr = clip(-gl / (hl + rules.L2)), clip(-gr / (hr + rules.L2))
                gain = loss(sum(g), sum(h), value) - loss(gl, hl, vl) - loss(gr, hr, vr)
                if (vr - vl) * monotone[f] >= 0 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, vl, vr)
        if best is None:
            assert fitted.feature[0, k] == -1 and fitted.value[0, k] == pytest.approx(rules.RATE * value)
            return
        _, f, _, vl, vr = best
        assert fitted.feature[0, k] == f
        cut, middle = fitted.cut[0, k], (vl + vr) / 2
        left, right = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
        assert len(left) == sum(x[i, f] <= best[2] for i in rows)
        a, b = ((lo, middle), (middle, hi)) if monotone[f] > 0 else ((middle, hi), (lo, middle)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
        check(2 * k + 1, left, *a, depth + 1)
        check(2 * k + 2, right, *b, depth + 1)

    check(0, list(range(300)), -math.inf, math.inf, 0)


def test_a_document_of_many_rows_is_one_row_of_the_sample(spark):
    docs = table(spark, [(1, f"text {i % 3}") for i in range(50)] + [(2, "b"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, 0)], "doc_id long, quality int")
    got = sorted((r["_id"], r["text"], r["quality"]) for r in toxicity.sample_of(spark, docs, labels, "quality", 5).collect())
    assert got == [(1, "text 0", 1), (2, "b", 0), (3, None, 1)]


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One line.\nOne line.\nTwo", "", None, "ÄÖ!! | a a a", prose(1, 500)]
    together = docstats.statistics(pa.array(texts, pa.string()))[0]
    alone = np.concatenate([docstats.statistics(pa.array([t], pa.string()))[0] for t in texts])
    assert np.allclose(together, alone) and (together[1] == 0).all() and (together[2] == 0).all()
    at = dict(zip(docstats.NAMES, together[0], strict=True))
    assert at["same_line"] == pytest.approx(1 / 3) and at["log_lines"] == pytest.approx(np.log(4)) and at["distinct_words"] == pytest.approx(3 / 5)


@pytest.mark.parametrize("run", [factorization.classify, rules.quality, toxicity.severity])
def test_edges(spark, edge, empty, labels, run):
    got = run(spark, edge, labels).toPandas()
    assert len(got) == edge.count() and got.notna().drop(columns="doc_id").all().all() and got["doc_id"].isna().sum() == 2
    assert run(spark, empty, labels).count() == 0
    none = labels.where("false")
    assert run(spark, edge, none).toPandas().drop(columns="doc_id").nunique().max() == 1
    assert run(spark, edge, labels.where("quality = 1 or toxic = 1").selectExpr("doc_id", "1 quality", "1 toxic")).count() == edge.count()


def test_rejection_of_edges(spark, edge, empty, labels):
    assert toxicity.reject_toxic(spark, empty, labels).count() == 0
    out = toxicity.reject_toxic(spark, edge, labels.where("false"))
    assert out.count() == edge.count() and out.columns == edge.columns

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from llm_helpers import prose, table

from sievework.llm.katz import FREQUENT, op8_katz_backoff, score, side_of

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def cut(text):
    words = WORD.findall((text or "").lower())
    return ["<s>", "<s>", *words, "</s>"] if words else None


class Brute:
    """The model from dictionaries, word by word."""

    def __init__(self, texts, least):
        self.docs, self.least = [d for t in texts if (d := cut(t))], least
        self.grams = {n: Counter(tuple(d[i - n + 1 : i + 1]) for d in self.docs for i in range(2, len(d))) for n in (1, 2, 3)}
        self.total = sum(self.grams[1].values())
        self.before = {n: Counter() for n in (1, 2, 3)}
        for n, seen in self.grams.items():
            for g, r in seen.items():
                self.before[n][g[:-1]] += r
        self.d = {}
        for n, seen in self.grams.items():
            coc = Counter(seen.values())
            top = 6 * coc[6] / coc[1] if coc[1] else 1.0
            for r in range(1, 6):
                x = ((r + 1) * coc[r + 1] / (r * coc[r]) - top) / (1 - top) if coc[r] and top < 1 else 1.0
                self.d[n, r] = x if 0 < x < 1 else 1 - 1 / (self.total + 1)
        self.after, self.alphas = {}, {}
        for n in (2, 3):
            for g, r in self.grams[n].items():
                if r >= least:
                    self.after.setdefault(g[:-1], []).append(g[-1])

    def own(self, g):
        n, r = len(g), self.grams[len(g)][g]
        return self.d.get((n, r), 1 - 1 / (self.total + 1)) * r / self.before[n][g[:-1]]

    def alpha(self, ctx):
        if ctx not in self.alphas:
            words = self.after.get(ctx, [])
            self.alphas[ctx] = (1 - sum(self.own((*ctx, w)) for w in words)) / (1 - sum(self.prob((*ctx[1:], w)) for w in words)) if self.before[len(ctx) + 1][ctx] else 1.0
        return self.alphas[ctx]

    def prob(self, g):
        if len(g) == 1:
            return self.own(g) if self.grams[1][g] else 1 - sum(self.own(k) for k in self.grams[1])
        return self.own(g) if self.grams[len(g)][g] >= self.least else self.alpha(g[:-1]) * self.prob(g[1:])


def rows():
    short = [(i, prose(i % 13, 15 + i % 7)) for i in range(60)]
    return [*short, (100, "one"), (101, "A b, a B"), (102, None), (103, ""), (104, "only once seen"), (105, prose(3, 1200))]


def check(got, m, scored):
    got = {r["doc_id"]: r for r in got.collect()}
    assert got.keys() == {d for d, t in scored if cut(t)}
    for d, text in scored:
        if not (w := cut(text)):
            continue
        grams = [tuple(w[i - 2 : i + 1]) for i in range(2, len(w))]
        logs = [math.log(m.prob(g)) for g in grams]
        r = got[d]
        assert r["tokens"] == len(logs) and r["log_prob"] == pytest.approx(sum(logs), rel=1e-8)
        assert r["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-8)
        assert r["backed_off"] == sum(m.grams[3][g] < m.least for g in grams)


@pytest.mark.parametrize("limit", [FREQUENT, 40])
@pytest.mark.parametrize("least", [1, 2])
def test_scores_equal_the_brute_force_model(spark, limit, least):
    """Whether words are frequent (numbers side by side) or rare (hashes) changes nothing."""
    data = rows()
    check(score(spark, table(spark, data).repartition(5), least=least, limit=limit), Brute([t for _, t in data], least), data)


@pytest.mark.parametrize("least", [1, 2])
def test_scores_of_other_documents_back_off_to_all_orders(spark, least):
    train, other = rows(), [(i, prose(i % 13 if i % 2 else i, 30)) for i in range(20)] + [(50, "never seen words"), (51, "one never"), (52, "")]
    m = Brute([t for _, t in train], least)
    check(score(spark, table(spark, other).repartition(3), table(spark, train), least, 60), m, other)
    words = [w for (w,) in m.grams[1]]
    for ctx in [*m.before[3], *m.before[2], ("<s>", "unseen"), ("unseen", words[0])]:
        assert sum(m.prob((*ctx, w)) for w in [*words, "<unknown>"]) == pytest.approx(1, abs=1e-9)


def test_the_query_keeps_what_is_seen_once(spark, tmp_path):
    data = [*rows(), *[(200 + i, prose(50 + i, 60)) for i in range(40)]]
    table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    m = Brute([t for _, t in data], 1)
    assert m.d[3, 1] < 1 and sum(r == 1 for r in m.grams[3].values()) > 1000
    check(op8_katz_backoff(spark, str(tmp_path)), m, data)


def test_edges(spark, edge, empty):
    got = score(spark, edge).toPandas()
    assert sorted(got["doc_id"]) == [3, 3, 4, 6, 7, 8, 10] and got["log_prob"].notna().all() and (got["log_prob"] <= 0).all()
    assert got.loc[got["doc_id"] == 4, "tokens"].item() == 120_001
    assert score(spark, empty).count() == 0 and score(spark, empty, edge).count() == 0
    assert score(spark, edge, empty).toPandas()["log_prob"].eq(0).all()


@pytest.mark.parametrize("limit", [FREQUENT, 40])
def test_held_scores_back_off_in_the_model_of_the_other_half(spark, limit):
    data = [*rows(), *[(200 + i, prose(50 + i // 2, 60)) for i in range(40)], (300, "twice"), (300, "twice")]
    side = dict(zip([d for d, _ in data], side_of(np.array([d for d, _ in data])).tolist(), strict=False))
    got = score(spark, table(spark, data).repartition(5), limit=limit, held=True).withColumnsRenamed({c: f"own_{c}" for c in ("log_prob", "perplexity", "backed_off")})
    got = got.withColumnsRenamed({f"held_{c}": c for c in ("log_prob", "perplexity", "backed_off")})
    assert got.where("doc_id = 300").count() == 2
    for k in (0, 1):
        own, other = ([(d, t) for d, t in data if (side[d] == k) == mine] for mine in (True, False))
        m = Brute([t for _, t in other], 1)
        check(got.where(got["doc_id"].isin([d for d, _ in own])), m, own)
        words = [[tuple(w[i - 2 : i + 1]) for i in range(2, len(w))] for _, t in own if (w := cut(t))]
        deep = [sum(not m.grams[n][g[3 - n :]] and m.before[n][g[3 - n : -1]] > 0 for d in words for g in d) for n in (2, 3)]
        assert min(deep) > 20  # both weights were asked for


def test_the_query_backs_off(spark, edge, empty, tmp_path):
    table(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_katz_backoff(spark, str(tmp_path)).toPandas()
    assert (got["held_backed_off"] > 0).any() and (got["backed_off"] == 0).all()
    held = score(spark, edge, held=True).toPandas()
    assert sorted(held["doc_id"]) == [3, 3, 4, 6, 7, 8, 10] and held["held_log_prob"].notna().all() and (held["held_log_prob"] <= 0).all()
    assert score(spark, empty, held=True).count() == 0
    with pytest.raises(ValueError):
        score(spark, edge, least=2, held=True)


def test_no_shuffle_file_outlives_its_query(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for f in disk.getAllFiles().mkString("\n").split("\n") if (n := f.rpartition("/")[2]).startswith("shuffle_")}
    before, docs = files(), table(spark, rows()).repartition(3)
    score(spark, docs)
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.5)
    assert not left

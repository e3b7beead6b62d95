import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.passages import _edits, align, chains, cut_passages, shared_passages

from llm_helpers import prose, table


def planted(n=60, edits=0):
    """Unrelated documents, every third with one of four passages of 60 words, of which up to edits words differ."""
    rng = random.Random(1)
    passages = [prose(9000 + k, 60) for k in range(4)]
    rows, where = [], {}
    for i in range(n):
        w = prose(100 + i, rng.randrange(30, 150)).split()
        if i % 3 == 0:
            k = rng.randrange(4)
            p = passages[k].split()
            for _ in range(rng.randrange(edits + 1)):
                p[rng.randrange(60)] = rng.choice(["qq", "vv"])
            at = rng.randrange(len(w))
            w[at:at] = p
            where[i] = (k, at)
        rows.append((i, " ".join(w)))
    return rows, where


def test_planted_passages_are_found_and_nothing_else(spark):
    for edits in (0, 3):
        rows, where = planted(edits=edits)
        got = shared_passages(spark, table(spark, rows)).toPandas()
        first = {}
        for d, (k, _) in sorted(where.items()):
            first.setdefault(k, d)
        later = {d for d, (k, _) in where.items() if first[k] != d}
        assert set(got["doc_id"]) <= later and len(set(got["doc_id"])) >= 0.9 * len(later)
        for r in got.itertuples():
            at = where[r.doc_id][1]
            assert abs(r.first_word - at) <= 12 and abs(r.end_word - at - 60) <= 12
            assert where[r.source_doc_id][0] == where[r.doc_id][0] and r.source_doc_id < r.doc_id and r.identity >= 0.7


def test_cutting_leaves_the_rest_of_the_text(spark):
    rows, where = planted()
    docs = table(spark, rows)
    out = {r["doc_id"]: r for r in cut_passages(spark, docs).collect()}
    first = {}
    for d, (k, _) in sorted(where.items()):
        first.setdefault(k, d)
    for d, t in rows:
        r = out[d]
        if d not in where or first[where[d][0]] == d:
            assert r["text"] == t
        else:
            at = where[d][1]
            w = t.split()
            assert r["text"].split() == w[:at] + w[at + 60 :] and r["n_chars"] == len(r["text"])
    assert cut_passages(spark, docs).columns == docs.columns


def test_a_passage_whose_halves_occur_alone_earlier(spark):
    left, right, more = prose(9100, 30), prose(9101, 30), prose(9102, 30)
    alone = [f"{prose(300 + i, 40)} {(left, right, more)[i % 3]} {prose(400 + i, 40)}" for i in range(6)]
    both = [f"{prose(500 + i, 50)} {left} {right} {prose(600 + i, 50)}" for i in range(3)]
    three = [f"{prose(700 + i, 50)} {left} {right} {more} {prose(800 + i, 50)}" for i in range(2)]
    got = shared_passages(spark, table(spark, list(enumerate([*alone, *both, *three])))).toPandas()
    longest = got.assign(n=got["end_word"] - got["first_word"]).groupby("doc_id")["n"].max()
    assert set(longest.index) == {7, 8, 9, 10} and (longest[[7, 8, 9]] >= 58).all() and longest[10] >= 88


def test_every_copy_in_a_later_document_is_found(spark):
    p, gap = prose(9200, 60), [prose(9300 + i, 50) for i in range(5)]
    part = " ".join(p.split()[:35])
    rows = [(0, f"{gap[0]} {p}"), (1, f"{gap[1]} {p} {gap[2]} {p} {gap[3]}"), (2, f"{part} {gap[4]} {p}")]
    docs = table(spark, rows)
    got = shared_passages(spark, docs).toPandas()
    spans = lambda d: sorted(got.loc[(got["doc_id"] == d) & (got["source_doc_id"] == 0), ["first_word", "end_word"]].itertuples(index=False, name=None))
    assert spans(1) == [(50, 110), (160, 220)] and spans(2) == [(85, 145)]
    out = {r["doc_id"]: r["text"].split() for r in cut_passages(spark, docs).collect()}
    assert out[1] == f"{gap[1]} {gap[2]} {gap[3]}".split() and out[2] == f"{part} {gap[4]}".split()


def brute_chain(x, y, gap=0.1, weight=5):
    best = 0.0
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    score = {}
    for i in order:
        score[i] = weight + max([0.0, *[score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i]]])
        best = max(best, score[i])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40, unique=True))
def test_first_chain_is_the_best(points):
    x, y = (np.array(v) for v in zip(*points, strict=True))
    found = chains(x, y)
    value = lambda c: 5 * len(c) - 0.1 * ((x[c[-1]] - x[c[0]]) + (y[c[-1]] - y[c[0]]))
    assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)
    assert sum(len(c) for c in found) == len(x)
    want = brute_chain(x, y)
    assert max(value(c) for c in found) <= want + 1e-6
    if (max(np.ptp(x), np.ptp(y)) if len(x) > 1 else 0) <= 40:
        assert abs(max(value(c) for c in found) - want) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_edit_distance(p, q):
    row = list(range(len(q) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(q, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    assert _edits(np.array(p), np.array(q)) == row[-1]


def test_alignment_of_equal_words():
    p = np.arange(50)
    assert align(p, p, np.array([10]), np.array([10])) == (0, 50, 0, 50, 1.0)


def test_edges(spark, edge, empty):
    got = shared_passages(spark, edge).toPandas()
    assert [tuple(r) for r in got[["doc_id", "source_doc_id", "first_word", "end_word"]].to_numpy()] == [(8, 7, 0, 80)]
    kept = cut_passages(spark, edge)
    assert kept.count() == edge.count() - 1 and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id = 2 and text is null").count() == 1
    assert shared_passages(spark, empty).count() == 0 and cut_passages(spark, empty).count() == 0


def covered_runs(words, found, least):
    """(words of later documents in runs of at least least words that an earlier one has too, those of them that are reported)."""
    total = hit = 0
    for d in words:
        shared = np.zeros(len(words[d]), bool)
        for a in (a for a in words if a < d):
            at = {}
            for i in range(len(words[a]) - least + 1):
                at.setdefault(tuple(words[a][i : i + least]), i)
            for j in range(len(words[d]) - least + 1):
                if tuple(words[d][j : j + least]) in at:
                    shared[j : j + least] = True
        told = np.zeros(len(words[d]), bool)
        for lo, hi in found.get(d, []):
            told[lo:hi] = True
        total, hit = total + int(shared.sum()), hit + int((shared & told).sum())
    return total, hit


def test_equal_runs_are_found_whatever_parts_of_them_stand_in_earlier_documents(spark):
    """Against all pairs of documents: the texts hold parts of three long texts, so parts of every passage are in many documents."""
    rng = random.Random(8)
    long = [[prose(9400 + 20 * k + i, rng.randrange(12, 40)) for i in range(12)] for k in range(3)]

    def part():
        at = rng.randrange(11)
        return " ".join(rng.choice(long)[at : at + rng.randrange(1, 5)])

    rows = [(i, " ".join([part(), prose(10_000 + i, 20), part(), prose(11_000 + i, 20)])) for i in range(120)]
    words = {d: t.split() for d, t in rows}
    for hot in (1 << 20, 4):
        found = {}
        for r in shared_passages(spark, table(spark, rows), hot).collect():
            found.setdefault(r["doc_id"], []).append((r["first_word"], r["end_word"]))
            assert r["source_doc_id"] < r["doc_id"]
        total, hit = covered_runs(words, found, 58)
        assert total > 1000 and hit >= 0.99 * total


def test_runs_of_one_word_are_no_passage(spark):
    rows = [(i, f"{prose(20 + i, 40)} {'the ' * 90} {prose(40 + i, 40)}") for i in range(4)]
    assert shared_passages(spark, table(spark, rows)).count() == 0


def test_many_partners_of_one_document(spark, monkeypatch):
    from sievework.llm import passages

    monkeypatch.setattr(passages, "ASKED", 3)
    p = prose(9500, 70)
    rows = [(i, f"{prose(600 + i, 30)} {p} {prose(700 + i, 30)}") for i in range(25)]
    got = shared_passages(spark, table(spark, rows)).toPandas()
    assert set(got["doc_id"]) == set(range(1, 25)) and (got["end_word"] - got["first_word"] >= 60).all() and set(got.loc[got["source_doc_id"] == 0, "doc_id"]) == set(range(1, 25))

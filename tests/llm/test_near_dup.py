import random

import numpy as np

from sievework.llm.near_dup import THRESHOLD, keep_one, near_duplicates

from llm_helpers import prose, table


def words(t):
    return "".join(c.lower() if c.isalnum() else " " for c in t).split()


def brute(rows):
    sets = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)} for d, t in rows if (w := words(t))}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= THRESHOLD}


def corpus():
    rng = random.Random(0)
    rows = [(i, prose(i, rng.randrange(20, 200))) for i in range(150)]
    for i in range(150, 300):  # copies at every similarity, some of them many times
        w = rows[rng.randrange(150) if i % 3 else 7][1].split()
        for _ in range(int(len(w) * rng.random() * 0.2)):
            w[rng.randrange(len(w))] = rng.choice(["xx", "yy", "zz"])
        rows.append((i, " ".join(w)))
    return rows + [(300 + i, rows[3][1].upper() + "!") for i in range(40)]


def test_groups_reach_the_brute_force_pairs(spark):
    rows = corpus()
    want = brute(rows)
    got = near_duplicates(spark, table(spark, rows)).toPandas()
    root = dict(zip(got["doc_id"], got["keeper"], strict=True))
    assert sum(root.get(a, a) == root.get(b, -b - 1) for a, b in want) >= 0.97 * len(want)
    parent = {d: d for d, _ in rows}  # no group is larger than a brute-force component

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(d) == find(k) for d, k in root.items())
    assert (got.groupby("keeper")["doc_id"].min().reset_index().eval("doc_id == keeper")).all() and (got["group_size"] >= 2).all()
    assert got["kept"].sum() == got["keeper"].nunique() and np.array_equal(got["kept"], got["doc_id"] == got["keeper"])


def test_keep_one_leaves_clean_documents_and_columns(spark):
    rows = corpus()
    docs = table(spark, rows)
    out = keep_one(spark, docs)
    assert out.columns == docs.columns
    gone = {d for d, _ in rows} - {r["doc_id"] for r in out.select("doc_id").collect()}
    paired = {b for _, b in brute(rows)}
    assert gone <= paired and 0 not in gone


def test_edges(spark, edge, empty):
    got = {r["doc_id"]: r["keeper"] for r in near_duplicates(spark, edge).collect()}
    assert got == {7: 7, 8: 7}
    assert keep_one(spark, edge).count() == edge.count() - 1
    assert near_duplicates(spark, empty).count() == 0 and keep_one(spark, empty).count() == 0


def test_of_differing_texts_under_one_id_only_the_one_that_was_compared_goes(spark):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(2, 80)), (3, prose(2, 80)), (None, prose(1, 80)), (4, None), (4, "")]
    docs = table(spark, rows)
    left = sorted((r["doc_id"] or -1, r["text"] or "") for r in keep_one(spark, docs).collect())
    gone = {r["doc_id"]: r["keeper"] for r in near_duplicates(spark, docs).where("not kept").collect()}
    assert len(gone) == 1 and len(left) == len(rows) - 1 and {t for _, t in left} >= {prose(1, 80), prose(2, 80)}

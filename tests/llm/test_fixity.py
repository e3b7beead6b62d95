from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm.fixity import audit, leaves, parents, records, tree
from sievework.llm.common import Scratch


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, body string, archive int")


def brute(one, two, per):
    a, b = (Counter((p, u or "", h or "") for p, u, h in rows if p is not None) for rows in (one, two))
    out = Counter()
    for p in {x[0] for x in a} | {x[0] for x in b}:
        x = sum(((a - b)[k] for k in a - b if k[0] == p))
        y = sum(((b - a)[k] for k in b - a if k[0] == p))
        for state, n in (("corrupt", min(x, y)), ("missing", x - min(x, y)), ("extra", y - min(x, y))):
            if n:
                out[(p // per, p, state)] = n
    return out


BASE = [(i, f"u{i}", "<p>" + "z" * (i % 50) + str(i)) for i in range(300)]
CASES = {
    "same": (BASE, BASE),
    "changed": (BASE, [(p, u, h + "!" if p in (3, 77, 299) else h) for p, u, h in BASE]),
    "lost and added": ([r for r in BASE if r[0] != 200], [r for r in BASE if r[0] not in (0, 150)] + [(7, "u", "new"), (900, "u", "far")]),
    "nulls and repeats": ([*BASE[:20], (5, None, None), (5, None, None), (6, "u6", None), (None, "u", "h")], [*BASE[:20], (5, None, None), (6, "u6", "")]),
    "empty": ([], BASE[:5]),
    "both empty": ([], []),
}


@pytest.mark.parametrize("case", CASES)
def test_audit_equals_brute_force(spark, case):
    one, two = CASES[case]
    got = audit(spark, records(pages(spark, one), 64), records(pages(spark, two).repartition(5), 64), 4)
    assert Counter((r["archive"], r["page_id"], r["state"]) for r in got.collect()) == brute(one, two, 64)


def test_offsets_name_the_bytes(spark):
    rows = records(pages(spark, BASE), 1000)
    body = "".join(r["body"] for r in rows.orderBy("page_id").collect())
    got = audit(spark, rows, rows.where("page_id <> 42")).first()
    assert body[got["offset"] : got["offset"] + got["length"]] == rows.where("page_id = 42").first()["body"]


def test_one_change_reaches_the_root_and_nothing_beside(spark):
    with Scratch(spark) as sc:
        a = tree(sc, records(pages(spark, BASE), 1000), 4)
        b = tree(sc, records(pages(spark, [(p, u, "q" + h[1:] if p == 100 else h) for p, u, h in BASE]), 1000), 4)
        assert [t.count() for t in a] == [300, 75, 19, 5, 2, 1]
        assert [x.select("i", "hash").exceptAll(y.select("i", "hash")).count() for x, y in zip(a, b, strict=True)] == [1] * 6
        assert parents(leaves(records(pages(spark, []), 10))).select(F.count("hash")).first()[0] == 0

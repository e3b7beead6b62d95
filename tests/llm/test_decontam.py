import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.common import buffer_of, words_of
from sievework.llm.decontam import build, contaminated, drop_contaminated, patterns_of, search

from llm_helpers import prose, table


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab c", min_size=0, max_size=60), min_size=1, max_size=5), st.lists(st.text("ab c", min_size=0, max_size=40), min_size=1, max_size=4), st.integers(1, 5))
def test_search_equals_brute_force(texts, items, n):
    least = 1 if n > 3 else 3
    tables = build(patterns_of(list(enumerate(items)), n, least))
    d, at, p = search(tables, words_of(buffer_of(pa.array(texts))))
    got = {(int(a), int(b), int(c)) for a, b, c in zip(d, at, p, strict=True)}
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        for k, item in enumerate(items):
            q = item.split()
            size = min(n, len(q))
            runs = {tuple(q[j : j + size]) for j in range(len(q) - size + 1)} if len(q) >= min(least, n) else set()
            want |= {(i, j, k) for j in range(len(w) - size + 1) if tuple(w[j : j + size]) in runs} if runs else set()
    assert got == want


def test_shared_runs_are_found_and_near_misses_are_not(spark):
    bench = spark.createDataFrame([(1, prose(1, 40)), (2, prose(2, 30)), (3, "Only four words here"), (4, ""), (5, None), (None, "x y"), (1, prose(1, 40))], "item_id long, text string")
    one, two = prose(1, 40).split(), prose(2, 30).split()
    rows = [(1, "start " + " ".join(one[5:18]).upper() + ", end"), (2, " ".join(one[5:17]) + " end"), (3, "said: only FOUR words, here!"), (4, prose(77, 500) + " " + " ".join(two) + " " + prose(78, 500)), (5, prose(79, 100)), (6, None)]
    docs = table(spark, rows)
    got = {(r["doc_id"], r["item_id"]): (r["hits"], r["first_word"]) for r in contaminated(spark, docs, bench).collect()}
    assert got == {(1, 1): (1, 1), (3, 3): (1, 1), (4, 2): (18, 500)}
    kept = drop_contaminated(spark, docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 6] and kept.columns == docs.columns


def test_a_long_text_is_searched_to_its_end(spark, edge):
    end = " ".join(prose(4, 120_000).split()[-20:])
    bench = spark.createDataFrame([(1, end)], "item_id long, text string")
    assert [(r["doc_id"], r["hits"], r["first_word"]) for r in contaminated(spark, edge, bench).collect()] == [(4, 8, 119_980)]
    assert drop_contaminated(spark, edge, bench).count() == edge.count() - 1


def test_empty_sides(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(spark, edge, none).count() == 0 and drop_contaminated(spark, edge, none).count() == edge.count()
    assert contaminated(spark, empty, some).count() == 0 and np.array_equal(search([], words_of(buffer_of(pa.array(["a"]))))[0], [])


def test_short_items_are_no_contamination_and_large_benchmarks_come_in_blocks(spark):
    long = [prose(40 + i, 30) for i in range(6)]
    bench = spark.createDataFrame([(1, "the"), (2, "x y z"), (3, "four words of text"), *[(10 + i, t) for i, t in enumerate(long)]], "item_id long, text string")
    docs = table(spark, [(1, "the x y z"), (2, "all four words of text here"), *[(10 + i, f"{prose(90 + i, 20)} {t}") for i, t in enumerate(long)]])
    for block in (2_000_000, 40):
        got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark, docs, bench, block=block).collect()}
        assert got == {(2, 3), *[(10 + i, 10 + i) for i in range(6)]}
        assert [r["doc_id"] for r in drop_contaminated(spark, docs, bench, block=block).collect()] == [1]

import base64
import os

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import prose, table

from sievework.llm.mixing import END, TOKENIZER, Encoder, draw, mix_sources, permute, tokenizer_of

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def whole_text():
    import public_tokenizers

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1' .\n\t    éß漢🙂's"), max_size=30), min_size=1, max_size=4))
def test_ids_are_those_of_the_whole_text(whole_text, texts):
    enc = Encoder(*tokenizer_of(TOKENIZER))
    ids, lo = enc(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(lo[:-1], lo[1:], strict=True)] == [whole_text.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    got = permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
    assert sorted(got.tolist()) == list(range(n))
    assert n < 10 or (got != np.arange(n)).any()


def corpus(spark):
    rows = [table(spark, [(s * 100 + i, prose(s * 100 + i, 20 + 13 * i)) for i in range(n)], f"src{s}") for s, n in ((0, 30), (1, 12), (2, 3))]
    return rows[0].union(rows[1]).union(rows[2])


def streams(docs, enc):
    out = {}
    for r in sorted(docs.collect(), key=lambda r: (r["source"] or "", r["doc_id"] is not None, r["doc_id"] or 0)):
        if r["text"]:
            out.setdefault(r["source"] or "", []).extend([*enc.encode_ordinary(r["text"]), END])
    return out


def test_blocks_draws_and_order(spark, whole_text):
    docs = corpus(spark)
    got = mix_sources(spark, docs.repartition(5), length=64, per_shard=16).toPandas()
    again = mix_sources(spark, docs.repartition(2), length=64, per_shard=16).toPandas()
    key = ["shard", "source", "slot"]
    assert got.sort_values(key)["tokens"].tolist() == again.sort_values(key)["tokens"].tolist()
    want = streams(docs, whole_text)
    blocks = {s: -(-len(v) // 64) for s, v in want.items()}
    assert len(got) == sum(blocks.values())
    for r in got.itertuples():
        ids = np.frombuffer(r.tokens, np.uint16)
        part = want[r.source][r.block * 64 : r.block * 64 + 64]
        assert len(ids) == 64 and ids.tolist() == part + [END] * (64 - len(part))
    for s, g in got.groupby("source"):
        assert sorted(g["slot"]) == list(range(len(g))) and (g["slot"] // blocks[s] == g["epoch"]).all()
        assert not g.duplicated(["epoch", "block"]).any()
    total = len(got)
    for shard, g in got.groupby("shard"):
        n = draw(int(shard), min(16, total - 16 * shard), np.full(3, 1 / 3), 4)
        assert [int((g["source"] == s).sum()) for s in sorted(blocks)] == n.tolist()


def test_weights(spark):
    got = mix_sources(spark, corpus(spark), {"src0": 3.0, "src2": 1.0, "none": 5.0}, length=32).toPandas()["source"].value_counts(normalize=True)
    assert set(got.index) == {"src0", "src2"} and abs(got["src0"] - 0.75) < 0.1


def test_edges(spark, edge, empty, whole_text):
    got = mix_sources(spark, edge, length=32).toPandas()
    want = streams(edge, whole_text)
    assert set(got["source"]) == {"s", ""} and len(got) == sum(-(-len(v) // 32) for v in want.values())
    long = got[got["source"] == "s"].drop_duplicates("block")
    assert {i for ids in long["doc_ids"] for i in ids} <= {3, 4, 5, 6, 7, 8, 9}
    assert mix_sources(spark, empty).count() == 0

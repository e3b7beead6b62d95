import corpus_pipeline
import pytest
from llm_helpers import prose, table


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Clean, toxic, copied and contaminated documents, and such as share a passage."""
    d = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(501, 70), prose(502, 40)
    rows = [(i, prose(i, 60 + i % 90)) for i in range(120)]
    rows += [(200 + i, f"{prose(300 + i, 50)} grobnik slurmo vexhate {prose(400 + i, 20)} slurmo grobnik vexhate") for i in range(30)]
    rows += [(300 + i, prose(i, 60 + i % 90) + (" tail" if i % 2 else "")) for i in range(10)]
    rows += [(400 + i, f"{prose(600 + i, 80)} {passage} {prose(700 + i, 80)}") for i in range(4)]
    rows += [(500, f"{prose(800, 100)} {item} {prose(801, 100)}"), (501, None), (502, "")]
    table(spark, rows).drop("_id", "_gone", "_l", "_y", "_spans", "_new", "_cut_id", "tie").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_takes_what_it_should_and_no_more(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone, clean = {}, {*range(120), *range(400, 404)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ({r["doc_id"]: r["text"] for r in t.collect()} for t in (docs, out))
        gone[name] = before.keys() - after.keys()
        changed = {d for d in after if after[d] != before[d]}
        assert changed == ({401, 402, 403} if name == "substring_dedup" else set())
        docs = spark.createDataFrame(out.collect(), out.schema)
    toxic = set(range(200, 230))
    assert toxic <= gone["toxicity"] and len(gone["toxicity"] - toxic) <= 2  # a model of 100 labels
    assert {d for d in range(300, 310) if d - 300 not in gone["toxicity"]} == gone["minhash_near_dedup"]
    assert gone["substring_dedup"] == set() and gone["decontamination"] == {500}
    assert clean - gone["toxicity"] <= {r["doc_id"] for r in docs.collect()}


def test_run_gives_blocks_of_what_is_left(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    ids = {i for row in got["doc_ids"] for i in row}
    assert len(got) > 0 and not ids & {*range(200, 230), *range(300, 310), 500} and (got["tokens"].map(len) == 2048).all()


def test_no_documents_give_no_blocks(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        (t.where("false") if name == "documents" else t).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_nulls_and_repeated_rows_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 3")
    odd = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars"))
    odd = odd.unionByName(docs.selectExpr("doc_id + 1000 doc_id", "cast(null as string) text", "lang", "source", "n_chars")).selectExpr("*", "1 as _mark", "2 as _spans")
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), odd.schema)
    assert kept.count() == odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() > 0

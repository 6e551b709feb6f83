"""The corpus pipeline stage by stage against brute force, each stage on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import packing, quality, token_counts
from tests.llm import brute
from tests.llm.test_contracts import HARD, line_result

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with hard rows among the documents, and a column of its own."""
    out = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(10**9 + k, t, None, "x", None) for k, t in HARD], docs.schema)
    docs.unionByName(more).withColumn("score", F.lit("mine")).withColumn("n_removed_chunks", F.lit("own")).withColumn("a.b", F.lit(1)).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    to = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{to}/{k}")
        out.append(spark.read.parquet(f"{to}/{k}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_keep_the_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert all(t.filter("n_removed_chunks <> 'own' or `a.b` <> 1").isEmpty() for t in tables[:-1])


def test_quality_keeps_what_the_rules_keep(spark, tables, folder):
    got = quality.quality_rules(tables[0], spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["doc_id"] for r in got.filter("kept").collect()}
    assert set(texts(tables[1])) == kept and kept
    assert all(not brute.quality_base(t)[5] for t in texts(tables[1]).values())


def test_line_dedup_changes_texts_as_brute_force_does(tables):
    before, after = texts(tables[1]), texts(tables[2])
    expected = {i: r[3] for i, r in line_result(before).items() if r[2] == 0 or brute.words(r[3])}
    assert after == expected
    sizes = {r["doc_id"]: r["n_chars"] for r in tables[2].collect()}
    assert all(sizes[i] == len(t) for i, t in after.items() if t != before[i])


def test_one_document_of_each_group_stays(tables):
    before, after = texts(tables[2]), texts(tables[3])
    fps = {i: brute.fingerprint(t) for i, t in before.items()}
    ids = sorted(fps)
    groups = brute.components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert after == {i: before[i] for i in ids if groups[i] == i}


def test_contaminated_documents_go(spark, tables, folder):
    before, after = texts(tables[3]), texts(tables[4])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(after) == {i for i, e in brute.contamination(before, items).items() if not e[4]}


def test_every_document_left_is_packed_once(tables):
    assert sorted(r["doc_id"] for r in tables[5].collect()) == sorted(texts(tables[4]))


def test_documents_are_packed_by_tokens(spark):
    texts = ["one two three", None, "", "unbelievably" * 300, "ñandú 😀 " * 50, "a"]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = corpus_pipeline.packing_stage(spark, docs, "").collect()
    counts = token_counts.count_tokens(docs, token_counts.vocabulary("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {r["doc_id"]: r["n_tokens"] for r in counts} and max(r["n_tokens"] for r in got) > 300
    rows = {}
    for r in got:
        rows.setdefault((r["bucket"], r["batch"]), []).append(r)
    assert all(len(b) == 1 or len(b) * b[0]["bucket_length"] <= packing.BUDGET for b in rows.values())


def test_run_gives_the_last_stages_rows(spark, tables, folder):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, folder)) == rows(tables[5])


def test_empty_tables_pass_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()

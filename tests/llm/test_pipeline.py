"""The registered queries against SQL, and the pipeline's stages against what they promise."""
import pytest

import corpus_pipeline
from arealytics.llm.queries import ORACLE, QUERIES
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLE[name]) is None


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= set(kept)
        if name == "near_duplicates":
            found = corpus_pipeline.ngram_join.classes(docs.select("doc_id", "text")).collect()
            assert all(r["links"] == 0 for r in found)
        if name in ("secrets", "mixing"):
            assert {r["doc_id"] for r in rows} == before
        if name == "near_duplicates":
            had = any(r["spans"] for r in corpus_pipeline.secret_scan.scan(docs).collect())
        if name == "secrets":
            assert any("[SECRET]" in r["text"] for r in rows) or not had
            again = corpus_pipeline.secret_scan.scan(docs).collect()
            assert not any(r["spans"] for r in again)
        before = {r["doc_id"] for r in rows}
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == before


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
    assert docs.count() == 0

"""Every query over awkward and empty tables; SQL counterparts; the pipeline."""

import os
import zlib

import pytest

import corpus_pipeline
from compare import difference, duck
from fieldgauge.llm import queries as q

SF = "/root/testdata/sf0.001"
ROWS_PER_DOCUMENT = ["op1_quality", "op2_toxicity", "op3_near_duplicates", "op4_domain_rules",
                     "op5_wavelet_shards", "op7_language", "op8_token_counts", "op10_mixing",
                     "op11_alignment", "op12_simhash"]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(q.queries()[name](spark, folder), duck(folder), q.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_PER_DOCUMENT)
def test_awkward_rows(spark, tables, awkward, name):
    rows = q.queries()[name](spark, tables).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in awkward.collect())


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, empty_tables, name):
    assert q.queries()[name](spark, empty_tables).count() == 0


def test_no_texts_reach_the_folds():
    folds = {i: zlib.crc32(str(i).encode()) for i in range(40)}
    assert {v % 5 == 0 for v in folds.values()} == {True, False}


@pytest.mark.parametrize("name,fold,rest", [("op1_quality", 5, 0), ("op2_toxicity", 4, 2),
                                            ("op7_language", 4, 2)])
def test_held_out_and_range(spark, name, fold, rest):
    for r in q.queries()[name](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest)
        assert 0 <= r.score <= 1
        if "predicted" in r:
            assert r.predicted == int(r.score >= 0.3)


def test_pipeline(spark, tables, empty_tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.collect()}
        assert left <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), empty_tables).count() == 0, name
    assert corpus_pipeline.run(spark, empty_tables).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_rows(spark):
    from fieldgauge.llm import stages
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in stages.one_of_each(spark, docs, SF).collect()}
    classes = q.queries()["op3_near_duplicates"](spark, SF).collect()
    assert kept == {r.class_id for r in classes}
    pieces = corpus_pipeline.run(spark, SF).collect()
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    assert max(lengths.values()) <= 1024
    assert os.path.isdir(SF)

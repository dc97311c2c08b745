import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fieldgauge.operators.quality import require_columns
from fieldgauge.session import scratch_path, shared_dir
from fieldgauge.sources import readers, writers


def test_csv_with_mark_and_quotes(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text('﻿product_category_name,product_category_name_english\n'
                    'beleza,"health, ""beauty"""\n', encoding="utf-8")
    rows = readers.load_dimension(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("beleza", 'health, "beauty"')]


def test_marketplace_views(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text("order_id,payment_sequential,payment_type,payment_installments,"
                    "payment_value\na,1,card,3,12.30\n")
    readers.register_marketplace(spark, {"payments": str(path)})
    assert str(spark.sql("SELECT payment_value FROM payments").first()[0]) == "12.30"


def test_whitespace_with_trailing_blanks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1  0.5   -2 \n 1   2 0.25 7  \n\n")
    df = readers.load_whitespace(spark, str(tmp_path / "t.txt"), {
        "unit_nr": "int", "time_cycles": "int", "a": "double", "b": "double"})
    assert [tuple(r) for r in df.collect()] == [(1, 1, 0.5, -2.0), (1, 2, 0.25, 7.0)]
    assert len(readers.TURBOFAN_COLUMNS) == 26


def test_positional(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("".join(f"{v}  \n" for v in range(100, 400)))
    got = {r["unit_nr"]: r["RUL"] for r in
           readers.load_positional(spark, str(tmp_path / "truth.txt")).collect()}
    assert got == {i + 1: 100 + i for i in range(300)}


def test_missing_path_and_column(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.load_csv(spark, "/nowhere/at/all.csv", "a int")
    with pytest.raises(ValueError, match="table lacks column"):
        require_columns(spark.range(1), ["id", "x"], "table")


def test_scores_round_trip(spark):
    path = scratch_path(spark, "t")
    df = spark.range(5).withColumn("p", F.col("id") / 7).withColumn("k", F.col("id") % 2)
    for fmt in ("csv", "parquet"):
        writers.write_scores(df, path, ["id", "p", "k"], fmt=fmt)
        back = (readers.load_csv(spark, path, "id long, p double, k long") if fmt == "csv"
                else spark.read.parquet(path))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    parted = scratch_path(spark, "t")
    writers.write_scores(df, parted, ["id", "k"], partition_by=["k"])
    assert spark.read.parquet(parted).filter("k = 1").count() == 2


def test_report_document(spark):
    rows = spark.createDataFrame([("b", 2.5, None), ("a", 1.25, True)],
                                 "name string, v double, ok boolean")
    total = rows.agg(F.sum("v").cast("decimal(18,2)").alias("total"),
                     F.to_date(F.lit("2020-01-02")).alias("day"))
    doc = writers.report_document(spark, "demo", {
        "total": total, "rows": writers.records(rows, ["name"])})
    path = scratch_path(spark, "report")
    writers.write_report(doc, path)
    text = spark.read.text(f"{path}/report=demo").first()[0]
    assert json.loads(text) == {
        "total": {"total": 3.75, "day": "2020-01-02"},
        "rows": [{"name": "a", "v": 1.25, "ok": True}, {"name": "b", "v": 2.5, "ok": None}]}


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")

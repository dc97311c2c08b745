import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from fieldgauge.operators import metrics


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(5)
    rows = [("ab"[i % 2], r.randrange(2), round(r.random(), 2)) for i in range(600)]
    return spark.createDataFrame(rows, "g string, y int, p double")


def test_auc_equals_the_evaluator(spark, scored):
    judge = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert metrics.roc_auc(scored, "y", "p").first()["auc"] == pytest.approx(
        judge.evaluate(scored), abs=1e-12)
    for r in metrics.roc_auc(scored, "y", "p", ["g"]).collect():
        assert r["auc"] == pytest.approx(judge.evaluate(scored.filter(F.col("g") == r["g"])),
                                         abs=1e-12)


def test_auc_split_over_chunks(spark, scored):
    plain = sorted(map(tuple, metrics.roc_auc(scored, "y", "p", ["g"]).collect()))
    split = sorted(map(tuple, metrics.roc_auc(scored, "y", "p", ["g"], split_rows=5).collect()))
    assert split == plain


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.4)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()["auc"] is None


def test_regression(spark):
    pairs = [(10.0, 12.0), (20.0, 17.0), (30.0, 30.0), (None, 1.0)]
    df = spark.createDataFrame(pairs, "t double, p double")
    r = metrics.regression_metrics(df, "t", "p").first()
    assert r["n"] == 3
    assert r["rmse"] == pytest.approx(math.sqrt(13 / 3))
    assert r["mae"] == pytest.approx(5 / 3)
    assert r["r2"] == pytest.approx(1 - 13 / 200)
    assert r["late_penalty_score"] == pytest.approx(math.exp(0.2) + math.exp(3 / 13) - 2)


def test_classification(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.4), (0, 0.9), (0, 0.1)], "y int, p double")
    r = metrics.classification_metrics(df, "y", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    none = metrics.classification_metrics(df.filter("p < 0.5"), "y", "p").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)

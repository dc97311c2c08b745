import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fieldgauge.operators import clusters, models


def points(spark, n=1500, seed=3):
    r = random.Random(seed)
    homes = [(0, 0), (6, 1), (2, 7), (9, 9), (4, 3)]
    rows = [(i, h[0] + r.gauss(0, 1), h[1] + r.gauss(0, 1))
            for i in range(n) for h in [homes[i % len(homes)]]]
    return spark.createDataFrame(rows, "id long, x double, y double").repartition(5)


def fit(df, **kw):
    return clusters.kmeans_restarts(df, ["x", "y"], key=F.col("id"), **{
        "k": 4, "restarts": 10, "seed": 42, **kw})


def plain_cost(df, centres):
    return sum(min((r["x"] - c[0]) ** 2 + (r["y"] - c[1]) ** 2 for c in centres)
               for r in df.collect())


def test_best_of_all_starts_is_as_good_as_separate_fits(spark):
    df = points(spark).persist()
    got = fit(df)
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    separate = models.best_kmeans(vectors, k=4, restarts=10).summary.trainingCost
    assert got.cost == pytest.approx(separate, rel=1e-3)
    assert got.cost == pytest.approx(plain_cost(df, got.centres))
    assert got.cost == min(got.costs) and len(got.costs) == 10


def test_scans_do_not_grow_with_starts(spark):
    df = points(spark, 400).persist()
    one, many = fit(df, restarts=1, max_iter=6), fit(df, restarts=10, max_iter=6)
    assert one.scans <= 4 + 7 and many.scans <= 4 + 7


def test_steps_match_a_plain_version(spark):
    df = points(spark, 300).persist()
    start = fit(df, restarts=3, max_iter=0)
    after = fit(df, restarts=3, max_iter=40)
    rows = [(r["x"], r["y"]) for r in df.collect()]
    # From the best start's own end, a further plain step moves nothing.
    groups = {}
    for p in rows:
        j = min(range(4), key=lambda j: (math.dist(p, after.centres[j]), j))
        groups.setdefault(j, []).append(p)
    for j, ps in groups.items():
        mean = [sum(v) / len(ps) for v in zip(*ps, strict=True)]
        assert math.dist(mean, after.centres[j]) < 1e-3
    assert after.cost <= start.cost
    again = fit(df.repartition(2), restarts=3, max_iter=40)
    assert again.costs == pytest.approx(after.costs)


def test_first_centres_prefer_far_points(spark):
    # One far group of a hundredth: nearly every start must find it.
    rows = [(i, float(i % 7), 0.0) for i in range(990)] + [
        (i, 1000.0 + i % 3, 0.0) for i in range(990, 1000)]
    df = spark.createDataFrame(rows, "id long, x double, y double").persist()
    got = fit(df, k=2, restarts=8, max_iter=0)
    assert sum(c < 1e5 for c in got.costs) >= 7


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)] * 5, "id long, x double, y double")
    got = fit(df, k=3)
    assert got.cost == 0 and got.centres == [[1.0, 1.0]] * 3
    with pytest.raises(ValueError):
        fit(df.limit(0))


def test_missing_coordinates_get_no_segment(spark):
    df = points(spark, 60).withColumn("x", F.when(F.col("id") != 7, F.col("x")))
    got = models.segment_customers(df, ["x", "y"], k=3, restarts=2)
    assert [r["id"] for r in got.filter("segment IS NULL").collect()] == [7]
    assert got.columns == ["id", "x", "y", "segment"]

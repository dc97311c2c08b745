import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import features as ft, models, ordered
from fieldgauge.plans import churn, forecast


@pytest.fixture(scope="module")
def subjects(spark):
    r = random.Random(1)
    rows = []
    for i in range(800):
        tenure, charge = r.randrange(72), 20 + 80 * r.random()
        churned = int(r.random() < (0.9 if tenure < 20 else 0.1))
        rows.append((i, tenure, charge, r.choice(["b", "a", "c"]), churned))
    return spark.createDataFrame(
        rows, "id long, tenure int, charge double, plan string, churned int").repartition(4)


@pytest.fixture(scope="module")
def engines(spark):
    r = random.Random(9)
    rows = []
    for unit in range(40):
        life = r.randrange(30, 90)
        for c in range(1, life + 1):
            wear = c / life
            rows.append((unit, c, wear * 10 + r.random(), 5 - wear * 3 + r.random()))
    return spark.createDataFrame(rows, "unit int, cycle int, s_1 double, s_2 double").repartition(4)


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    got = sorted(map(tuple, models.standardise(df, ["a", "b"]).select("a_std", "b_std").collect()))
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_codes_are_alphabetical(spark, subjects):
    coded = models.encode_labels(subjects, ["plan"])
    assert {(r["plan"], r["plan_code"]) for r in coded.collect()} == {
        ("a", 0.0), ("b", 1.0), ("c", 2.0)}


def test_split_is_stable_and_stratified(spark, subjects):
    def test_ids(df, **kw):
        return {r["id"] for r in models.stratified_split(df, "id", "churned", **kw)
                .filter("is_test").collect()}
    ids = test_ids(subjects)
    assert ids == test_ids(subjects.repartition(7))
    exact = models.stratified_split(subjects, "id", "churned", exact=True)
    for r in exact.groupBy("churned").agg(F.count("*").alias("n"),
                                          F.count_if("is_test").alias("t")).collect():
        assert r["t"] == round(r["n"] * 0.25)
    assert test_ids(subjects, exact=True) == test_ids(subjects, exact=True, split_rows=50)


def test_best_of_several_starts(spark, subjects):
    vectors = VectorAssembler(inputCols=["tenure", "charge"], outputCol="features").transform(
        subjects)
    best = models.best_kmeans(vectors, k=4, restarts=4, max_iter=5)
    costs = [models.best_kmeans(vectors, k=4, restarts=1, seed=models.SEED + i, max_iter=5)
             .summary.trainingCost for i in range(4)]
    assert best.summary.trainingCost == pytest.approx(min(costs))


def test_segments_cover_all_customers(spark, subjects):
    table = subjects.withColumn("services", (F.col("id") % 5).cast("int"))
    got = churn.segments(table, "tenure", "services", "charge", "churned", restarts=2)
    assert sum(r["customers"] for r in got.collect()) == 800 and got.count() == 4


def test_model_comparison_repeats(spark, subjects):
    def run():
        scores, metrics, top = churn.model_comparison(
            subjects.withColumn("stake", F.lit(100)), "id", "churned", ["plan"],
            ["tenure", "charge"], keep=["stake"], trees=10, depth=4, max_iter=50)
        return scores, sorted(map(tuple, metrics.collect())), list(map(tuple, top.collect()))
    scores, metrics, top = run()
    assert (metrics, top) == run()[1:]
    assert all(m[1] > 0.65 for m in metrics)
    assert top[0][0] == "tenure" and sum(v for _, v in top) == pytest.approx(1.0)
    assert scores.groupBy("id").count().filter("count != 2").count() == 0
    table = churn.retention(scores, models.model_metrics(scores, "churned"), "churned", "stake")
    costs = {r["rank"]: r["total_cost"] for r in table.collect()}
    assert costs[3] <= costs[2] and costs[3] <= costs[1] + 100 * scores.count()


def test_forest_wins_a_tie(spark):
    df = spark.createDataFrame([(models.FOREST, 0.8441), (models.LOGISTIC, 0.8444)],
                               "model string, auc double")
    assert models.best_model(df).first()[0] == models.FOREST
    higher = spark.createDataFrame([(models.FOREST, 0.842), (models.LOGISTIC, 0.844)],
                                   "model string, auc double")
    assert models.best_model(higher).first()[0] == models.LOGISTIC


def test_labels_are_capped(spark, engines):
    got = ft.rul_labels(engines, "unit", "cycle", cap=20)
    for rs in got.groupBy("unit").agg(F.collect_list(F.struct("cycle", "RUL")).alias("r")).collect():
        last = max(r["cycle"] for r in rs["r"])
        assert all(r["RUL"] == min(last - r["cycle"], 20) for r in rs["r"])


def test_forecast_beats_the_mean_and_never_mixes_units(spark, engines):
    table = forecast.training_table(engines, ["s_1", "s_2"], unit="unit", cycle="cycle", cap=60)
    train, held = models.split_by_unit(table, "unit")
    assert not ({r["unit"] for r in train.select("unit").distinct().collect()}
                & {r["unit"] for r in held.select("unit").distinct().collect()})
    model, validation = forecast.train_baseline(table, ["s_1", "s_2"], unit="unit", trees=10,
                                                depth=4, rate=0.3)
    assert validation.count() == held.count() > 0
    rows = forecast.evaluate(models.predict(model, train), models.predict(model, validation))
    r2 = {r["split"]: r["r2"] for r in rows.collect()}
    assert r2["in_sample"] > 0.6 and r2["held_out"] > 0.5
    counts = models.split_counts(table, model.stages[-1], ft.feature_columns(["s_1", "s_2"]))
    assert sum(r["splits"] for r in counts.collect()) > 10


def test_service_response(spark, engines):
    table = forecast.training_table(engines, ["s_1", "s_2"], unit="unit", cycle="cycle", cap=60)
    model, _ = forecast.train_baseline(table, ["s_1", "s_2"], unit="unit", trees=5, depth=3)
    history = engines.filter("cycle <= 10")
    got = forecast.service_response(model, history, ["s_1", "s_2"], unit="unit", cycle="cycle",
                                    version="7").collect()
    assert len(got) == 40 and {r["cycle"] for r in got} == {10}
    assert all(r["alert"] == (r["predicted_RUL"] <= fx.FAILURE_HORIZON) for r in got)
    assert {r["model_version"] for r in got} == {"7"}


def test_truth_joins_the_last_cycle(spark, engines):
    last = forecast.last_cycles(engines.filter("cycle <= 20"), ["s_1"], unit="unit",
                                cycle="cycle")
    truth = spark.createDataFrame([(0, 200), (1, 30)], "unit int, RUL int")
    got = {r["unit"]: (r["cycle"], r["RUL"]) for r in
           forecast.with_truth(last, truth, unit="unit").collect()}
    assert got == {0: (20, 125), 1: (20, 30)}


def test_melt(spark, engines):
    got = ft.melt(engines.filter("unit = 0"), ["cycle"], ["s_1", "s_2"])
    assert got.columns == ["cycle", "variable", "value"]
    assert got.count() == 2 * engines.filter("unit = 0").count()


def test_fits_deal_rows_over_the_cores(spark, engines):
    cores = spark.sparkContext.defaultParallelism
    many = engines.repartition(5 * cores)
    dealt = models.dealt(many)
    assert dealt.rdd.getNumPartitions() == cores
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, engines.collect()))
    few = engines.coalesce(2)
    assert models.dealt(few) is few


def test_last_cycles_cut_rows_before_the_shuffle(spark, engines):
    last = forecast.last_cycles(engines, ["s_1"], unit="unit", cycle="cycle")
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()
    whole = ordered.last_row(ft.rolling_features(engines, ["s_1"], unit="unit", cycle="cycle"),
                             ["unit"], ["cycle"])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))


def test_classifiers_read_their_subjects_once(spark, subjects):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(charge):
        met.add(1)
        return charge
    models.compare_classifiers(subjects.withColumn("charge", counted("charge")), "id", "churned",
                               ["tenure", "charge"], trees=2, depth=2, max_iter=5)
    assert met.value == 800

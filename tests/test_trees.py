import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fieldgauge.operators import features as ft, models, trees
from fieldgauge.plans import forecast

FEATURES = ["x", "y", "idle"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(3000).selectExpr("id", "(id * 7919) % 100 / 10.0 x", "(id * 31) % 17 * 1.0 y",
                                      "0.0 idle").withColumn("z", F.col("x") * F.col("y"))
    rows = df.withColumn("label", (F.col("z") > 30).cast("int"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).persist()


@pytest.fixture(scope="module")
def boosted(table):
    return GBTRegressor(featuresCol="features", labelCol="z", maxIter=6, maxDepth=4,
                        seed=1).fit(table)


@pytest.fixture(scope="module")
def forest(table):
    return models.fit_forest(table, "label", trees=7, depth=4)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_importances_equal_those_of_the_model(spark, kind, request):
    model = request.getfixturevalue(kind)
    nodes = trees.nodes_of(spark, model)
    got = {r["feature"]: r["importance"] for r in
           trees.importances(nodes, FEATURES, per_tree=kind == "forest").collect()}
    own = dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))
    assert got == pytest.approx(own) and got["idle"] == 0


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_splits_and_shapes_equal_those_of_the_model(spark, table, kind, request):
    model = request.getfixturevalue(kind)
    splits = {r["feature"]: r["splits"] for r in
              models.split_counts(table, model, FEATURES).collect()}
    assert sum(splits.values()) == sum((t.numNodes - 1) // 2 for t in model.trees)
    assert splits["idle"] == 0
    shapes = trees.tree_shapes(trees.nodes_of(spark, model)).orderBy("tree").collect()
    assert [(r["nodes"], r["depth"]) for r in shapes] == [(t.numNodes, t.depth)
                                                         for t in model.trees]
    assert all(r["broken"] == 0 and r["reached"] == r["nodes"] for r in shapes)


def test_damaged_nodes_are_seen(spark, boosted):
    nodes = trees.nodes_of(spark, boosted)
    fewer = nodes.withColumn("rows", F.when((F.col("tree") == 2) & F.col("left").isNull(), 0)
                             .otherwise(F.col("rows")))
    shapes = {r["tree"]: r for r in trees.tree_shapes(fewer).collect()}
    assert shapes[2]["broken"] > 0 and shapes[1]["broken"] == 0
    cut = nodes.filter("NOT (tree = 1 AND node = 1)")
    shapes = {r["tree"]: r for r in trees.tree_shapes(cut).collect()}
    assert shapes[1]["reached"] < shapes[1]["nodes"]


def test_tree_without_a_split(spark, table):
    flat = table.withColumn("same", F.lit(1.0))
    model = GBTRegressor(featuresCol="features", labelCol="same", maxIter=1, seed=1).fit(flat)
    nodes = trees.nodes_of(spark, model)
    assert {r["importance"] for r in trees.importances(nodes, FEATURES, per_tree=False)
            .collect()} == {0.0}
    assert {r["splits"] for r in trees.split_table(nodes, FEATURES).collect()} == {0}
    assert trees.tree_shapes(nodes).first()["depth"] == 0


def test_boosting_ends_where_validation_error_is_least(spark):
    # A target of noise: soon each tree only learns the training units.
    series = spark.range(4000).select(
        (F.col("id") % 60).alias("unit"), F.expr("id div 60").cast("int").alias("cycle"),
        (F.xxhash64("id") % 100).cast("double").alias("s_1"))
    table = ft.rolling_features(series, ["s_1"], unit="unit", cycle="cycle").withColumn(
        "RUL", F.col("s_1") / 50
        + F.pmod(F.xxhash64("unit", "cycle"), F.lit(97)).cast("double"))
    model, sided = forecast.train_validated(table, ["s_1"], unit="unit", trees=40, depth=5,
                                            rate=0.3)
    kept = model.stages[-1].getNumTrees
    validation = sided.filter("side = 'validation'")
    curve = [r["mse"] for r in models.error_curve(model, validation).orderBy("trees").collect()]
    assert kept < 40 and len(curve) == kept and curve.index(min(curve)) == kept - 1
    got = models.predict(model, validation).agg(
        F.avg((F.col("predicted_RUL") - F.col("RUL")) ** 2)).first()[0]
    assert got == pytest.approx(curve[-1])
    sides = sided.groupBy("unit").agg(F.count_distinct("side").alias("n"))
    assert sides.filter("n > 1").isEmpty()
    held = models.split_by_unit(table, "unit")[1].select("unit").distinct().collect()
    assert {r["unit"] for r in held} == {
        r["unit"] for r in sided.filter("side = 'held_out'").select("unit").distinct().collect()}

"""Tree models as tables: one row per node, read from the data that a saved model holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgauge.session import scratch_path

NODES = ("tree", "weight", "node", "left", "right", "feature", "threshold", "gain", "prediction",
         "weighted_rows", "rows")


def node_table(spark: SparkSession, saved: str) -> DataFrame:
    """The nodes of the forest or boosted trees saved at ``saved``.

    ``saved`` is the folder of the tree model itself or of a pipeline that holds one (a glob such
    as ``model/stages/*`` finds it). A leaf has NULL for children, feature, threshold and gain; a
    split on categories has a NULL threshold. ``rows`` counts the training rows that reached a
    node, ``weighted_rows`` counts them by their weight, bagging included, where the model keeps it.
    """
    data = spark.read.parquet(f"{saved}/data")
    weights = spark.read.parquet(f"{saved}/treesMetadata").select(
        F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = "nodeData."
    split = F.col(n + "leftChild") >= 0

    def of_split(c):
        return F.when(split, c)
    # Variance keeps (count, sum, squares); Gini and entropy keep one count per class.
    stats = F.col(n + "impurityStats")
    nodes = data.select(
        F.col("treeID").alias("tree"), F.col(n + "id").alias("node"),
        of_split(F.col(n + "leftChild")).alias("left"),
        of_split(F.col(n + "rightChild")).alias("right"),
        of_split(F.col(n + "split.featureIndex")).alias("feature"),
        F.when(split & (F.col(n + "split.numCategories") < 0),
               F.get(F.col(n + "split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        of_split(F.col(n + "gain")).alias("gain"), F.col(n + "prediction").alias("prediction"),
        F.col(n + "rawCount").alias("rows"), stats.alias("stats"))
    return nodes.join(F.broadcast(weights), "tree")


def with_weighted_rows(nodes: DataFrame, *, classes: bool) -> DataFrame:
    """Add ``weighted_rows`` from the impurity statistics of a classifier or a regressor."""
    total = (F.aggregate("stats", F.lit(0.0), lambda a, b: a + b) if classes
             else F.get("stats", F.lit(0)))
    return nodes.withColumn("weighted_rows", total).select(*NODES)


def nodes_of(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted forest or boosted trees; its file lies in the shared folder."""
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    return with_weighted_rows(node_table(spark, path), classes=hasattr(model, "numClasses"))


def _named(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(features)), "feature int, name string")


def split_table(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each feature is split on, features never used included."""
    counts = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"))
    return _named(nodes.sparkSession, features).join(counts, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"))


def importances(nodes: DataFrame, features: Sequence[str], *, per_tree: bool) -> DataFrame:
    """Impurity importance: gain times weighted rows, summed per feature, to a total of one.

    ``per_tree`` brings every tree to one first, as is usual for forests and not for boosted
    trees. Without any split all figures are zero.
    """
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("weighted_rows")).alias("value"))
    if per_tree:
        # One row per tree and feature: model-sized.
        total = F.sum("value").over(Window.partitionBy("tree"))
        gains = gains.withColumn("value", F.when(total > 0, F.col("value") / total)
                                 .otherwise(0.0))
    summed = gains.groupBy("feature").agg(F.sum("value").alias("value"))
    total = summed.agg(F.sum("value")).scalar()
    return _named(nodes.sparkSession, features).join(summed, "feature", "left").select(
        F.col("name").alias("feature"),
        F.when(total > 0, F.coalesce("value", F.lit(0.0)) / total).otherwise(0.0)
        .alias("importance"))


def tree_shapes(nodes: DataFrame, *, max_depth: int = 30) -> DataFrame:
    """Per tree: nodes, splits, rows at the root, depth, and splits whose children do not hold
    all rows of their parent.

    Depth follows from walking the children level by level; nodes no walk reaches make ``reached``
    smaller than ``nodes``.
    """
    child = nodes.select("tree", F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    links = (nodes.filter("left IS NOT NULL")
             .select("tree", "node", "rows", F.explode(F.array("left", "right")).alias("child"))
             .join(child, ["tree", "child"]).checkpoint())
    broken = links.groupBy("tree", "node", "rows").agg(
        F.sum("child_rows").alias("below"), F.count(F.lit(1)).alias("children")).filter(
        "below != rows OR children != 2").groupBy("tree").agg(F.count(F.lit(1)).alias("broken"))
    level = nodes.filter("node = 0").select("tree", "node", F.lit(0).alias("level"))
    seen = level
    for _ in range(max_depth):
        level = (links.select("tree", "node", "child").join(level, ["tree", "node"])
                 .select("tree", F.col("child").alias("node"),
                         (F.col("level") + 1).alias("level"))).checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    depths = seen.groupBy("tree").agg(F.max("level").alias("depth"),
                                      F.count(F.lit(1)).alias("reached"))
    sizes = nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("left").alias("splits"),
        F.max(F.when(F.col("node") == 0, F.col("rows"))).alias("root_rows"))
    return (sizes.join(depths, "tree").join(broken, "tree", "left")
            .withColumn("broken", F.coalesce("broken", F.lit(0))))

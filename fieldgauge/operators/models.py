"""Model building on MLlib. Fits run on the executors; the driver sees model-sized results."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import clusters, selection, trees as nodes
from fieldgauge.operators.metrics import classification_metrics, roc_auc
from fieldgauge.operators.ordered import broadcast_if_small, row_position
from fieldgauge.session import shared_dir

# Settings of the reports' models.
SEED = 42
CLUSTERS, RESTARTS = 4, 10
TEST_SHARE = 0.25
#: Rows of one task while a model is fitted; MLlib keeps them as objects.
FIT_ROWS = 4_000_000
LOGISTIC, FOREST = "logistic_regression", "random_forest"


# --- preparation ---------------------------------------------------------

def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes zero.

    The statistics are one row. NULLs are ignored by them and stay NULL.
    """
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return apply_scaling(df, {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns}, suffix)


def scaling_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, to be applied to other data."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns}


def apply_scaling(df: DataFrame, scaling: dict[str, tuple[float, float]],
                  suffix: str = "_std") -> DataFrame:
    return df.withColumns({
        f"{c}{suffix}": (F.col(c).cast("double") - F.lit(mean)) / F.lit(dev or 1.0)
        for c, (mean, dev) in scaling.items()})


def encode_labels(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Numbers 0, 1, 2, … for the categories of each column in alphabetical order."""
    indexer = StringIndexer(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(df).transform(df)


def hash_number(key: str, seed: int = SEED) -> Column:
    """A whole number below 2^32 fixed by the key and the seed, whatever the partitioning."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_share(key: str, seed: int = SEED) -> Column:
    """The same as a number in [0, 1)."""
    return hash_number(key, seed).cast("double") / float(2 ** 32)


def stratified_split(df: DataFrame, key: str, stratum: str, *, test_share: float = TEST_SHARE,
                     seed: int = SEED, exact: bool = False,
                     split_rows: int | None = None) -> DataFrame:
    """Add ``is_test``. The same row always falls on the same side.

    By default a cut on the key's hash, which needs no shuffle and meets the share closely in
    every stratum. ``exact`` takes the rounded count per stratum, found by counting the digits of
    the hashes; ``split_rows`` ranks the hashes instead, strata above it in chunks.
    """
    if exact and split_rows is None:
        return selection.first_by_hash(df, key, stratum, hash_number(key, seed), test_share,
                                       out="is_test")
    hashed = df.withColumn("__share", hash_share(key, seed))
    if not exact:
        return hashed.withColumn("is_test", F.col("__share") < test_share).drop("__share")
    ranked = row_position(hashed, [stratum], ["__share", key], out="__rank",
                          split_rows=split_rows)
    sizes = broadcast_if_small(
        df.groupBy(F.col(stratum).alias("__stratum")).agg(F.count(F.lit(1)).alias("__n")))
    same = F.col(stratum).eqNullSafe(F.col("__stratum"))
    return (ranked.join(sizes, same, "left")
            .withColumn("is_test", F.col("__rank") <= F.round(F.col("__n") * test_share))
            .drop("__share", "__rank", "__stratum", "__n"))


def split_by_unit(df: DataFrame, unit: str, *, test_share: float = TEST_SHARE,
                  seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; a unit is never on both sides."""
    held_out = hash_share(unit, seed) < test_share
    return df.filter(~held_out), df.filter(held_out)


def _assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(c) if c in columns else F.col(c)
               for c in df.columns]
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        df.select(*doubles))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a fit, spread evenly over the session's cores if they lie in more partitions.

    MLlib reads them once per tree level or step, and from every partition sends statistics as
    long as the model to as many partitions. So their number follows from the cores, with at most
    ``FIT_ROWS`` rows in one, and not from the files that the rows come from.
    """
    cores, lie_in = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    if lie_in <= cores:
        return rows
    wanted = cores * max(1, math.ceil(rows.count() / (cores * FIT_ROWS)))
    return rows.repartition(wanted) if wanted < lie_in else rows


# --- segments ------------------------------------------------------------

def best_kmeans(features: DataFrame, *, k: int = CLUSTERS, restarts: int = RESTARTS,
                seed: int = SEED, max_iter: int = 300) -> KMeansModel:
    """Several starts, keeping the fit with the lowest cost."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(features) for i in range(restarts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def segment_customers(df: DataFrame, columns: Sequence[str], *, k: int = CLUSTERS,
                      restarts: int = RESTARTS, seed: int = SEED,
                      max_iter: int = 300) -> DataFrame:
    """Add a cluster number from k-means on the standardised columns.

    All restarts share their scans. Rows with a NULL among ``columns`` take no part in the fit
    and get a NULL segment.
    """
    scaled = standardise(df, columns)
    names = [f"{c}_std" for c in columns]
    fit_on = scaled.dropna(subset=names).select(
        *names, F.xxhash64(*df.columns).alias("__key")).persist(StorageLevel.MEMORY_AND_DISK)
    best = clusters.kmeans_restarts(fit_on, names, key=F.col("__key"), k=k, restarts=restarts,
                                    seed=seed, max_iter=max_iter)
    fit_on.unpersist()
    return clusters.assigned(scaled, names, best, "segment").select(*df.columns, "segment")


def segment_profile(df: DataFrame, segment: str, tenure: str, services: str, charge: str,
                    churned: str) -> DataFrame:
    """Size, averages, name and risk tier of each segment. Names rest on rounded averages."""
    averages = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.bround(F.avg(c).cast("double"), 2).alias(name) for c, name in (
            (tenure, "avg_tenure"), (services, "avg_services"),
            (charge, "avg_monthly_charge"), (churned, "churn_rate"))])
    return (averages
            .withColumn("label", fx.segment_label("churn_rate", "avg_tenure",
                                                  "avg_monthly_charge"))
            .withColumn("risk", fx.risk_tier("churn_rate")))


# --- classifiers ---------------------------------------------------------

def fit_logistic(train: DataFrame, label: str, *, c: float = 1.0, max_iter: int = 1000):
    """L2-penalised logistic regression on already scaled features."""
    strength = 1.0 / (c * max(train.count(), 1))
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=strength,
                              standardization=False, maxIter=max_iter).fit(train)


def fit_forest(train: DataFrame, label: str, *, trees: int = 200, depth: int = 8,
               seed: int = SEED):
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees,
                                  maxDepth=depth, seed=seed).fit(train)


def positive_probability(model, df: DataFrame, out: str = "prob") -> DataFrame:
    """Add the probability of class 1."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def compare_classifiers(df: DataFrame, key: str, label: str, features: Sequence[str], *,
                        keep: Sequence[str] = (), trees: int = 200, depth: int = 8,
                        max_iter: int = 1000, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Fit both classifiers on the training side and score the held-out side.

    Returns the held-out scores, one row per model and subject, and the forest's importances.
    """
    # Fixed once: every fit and score below reads it, and a lost executor costs no recomputing.
    shared_dir(df.sparkSession)
    rows = df.select(key, label, *keep, *features).checkpoint()
    split = stratified_split(rows, key, label, seed=seed, exact=True).checkpoint()
    train, test = dealt(split.filter(~F.col("is_test"))), split.filter("is_test")
    scaling = scaling_of(train, features)
    scaled = [f"{c}_std" for c in features]

    logistic_train = _assemble(apply_scaling(train, scaling), scaled).select("features", label)
    logistic_train.persist(StorageLevel.MEMORY_AND_DISK)
    logistic = fit_logistic(logistic_train, label, max_iter=max_iter)
    logistic_train.unpersist()
    forest = fit_forest(_assemble(train, features).select("features", label), label,
                        trees=trees, depth=depth, seed=seed)

    columns = [key, label, *keep]
    parts = [
        positive_probability(logistic, _assemble(apply_scaling(test, scaling), scaled))
        .select(F.lit(LOGISTIC).alias("model"), *columns, "prob"),
        positive_probability(forest, _assemble(test, features))
        .select(F.lit(FOREST).alias("model"), *columns, "prob")]
    return (parts[0].unionByName(parts[1]).checkpoint(),
            nodes.importances(nodes.nodes_of(df.sparkSession, forest), features, per_tree=True))


def model_metrics(scores: DataFrame, label: str, prob: str = "prob") -> DataFrame:
    """AUC, precision, recall and F1 per model."""
    auc = roc_auc(scores, label, prob, ["model"]).select("model", "auc")
    at_half = classification_metrics(scores, label, prob, by=["model"])
    return at_half.join(auc, "model").select("model", "auc", "precision", "recall", "f1")


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the higher AUC to three digits; the forest wins a tie."""
    rank = F.struct(F.bround("auc", 3), F.col("model") == FOREST)
    return metrics.agg(F.max_by("model", rank).alias("model"))


# --- regression ----------------------------------------------------------

def fit_boosted_regressor(train: DataFrame, features: Sequence[str], label: str, *,
                          trees: int = 100, depth: int = 5, rate: float = 0.05,
                          validation: str | None = None, tolerance: float = 0.0,
                          seed: int = SEED) -> PipelineModel:
    """Gradient-boosted trees behind an assembler, as one model that can be saved.

    Rows that miss a sensor teach nothing; the model answers them all the same, with a missing
    value taken as above every split. ``validation`` names a boolean column: its rows fit no tree,
    and boosting ends with the tree after which their error stops falling (by more than
    ``tolerance`` of itself), at most after ``trees``.
    """
    stop = {} if validation is None else {"validationIndicatorCol": validation,
                                          "validationTol": tolerance}
    booster = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth,
                           stepSize=rate, seed=seed, **stop)
    stages = [VectorAssembler(inputCols=list(features), outputCol="features",
                              handleInvalid="skip"), booster]
    used = [*features, label, *([] if validation is None else [validation])]
    model = Pipeline(stages=stages).fit(dealt(train.select(*used)))
    model.stages[0].setHandleInvalid("keep")
    return model


def error_curve(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean squared error on ``rows`` after 1, 2, … trees: one row per tree of the model."""
    assembler, regressor = model.stages
    known = rows.dropna(subset=assembler.getInputCols())
    errors = regressor.evaluateEachIteration(assembler.transform(known), "squared")
    return rows.sparkSession.createDataFrame(
        [(i, float(e)) for i, e in enumerate(errors, 1)], "trees int, mse double")


def save_model(model: PipelineModel, path: str, version: str, features: Sequence[str],
               settings: dict[str, float]) -> None:
    """Write a fitted model and its card: version, inputs in order, settings."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    card = spark.createDataFrame([(version, list(features), json.dumps(settings, sort_keys=True))],
                                 "version string, features array<string>, settings string")
    card.coalesce(1).write.mode("overwrite").json(f"{path}/card")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A model written by ``save_model``, with its card."""
    card = spark.read.schema("version string, features array<string>, settings string") \
        .json(f"{path}/card").first()
    return PipelineModel.load(f"{path}/model"), {
        "version": card["version"], "features": card["features"],
        "settings": json.loads(card["settings"])}


def predict(model: PipelineModel, df: DataFrame, out: str = "predicted_RUL") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out).drop("features")


# --- explanation ---------------------------------------------------------

def split_counts(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """How often each feature is split on. Reads the model's nodes, not the data."""
    return nodes.split_table(nodes.nodes_of(df.sparkSession, model), features)


def top_features(table: DataFrame, n: int = 10) -> DataFrame:
    measure = table.columns[1]
    return table.orderBy(F.desc(measure), "feature").limit(n)

"""Remaining-life forecast: train, evaluate on held-out units, score and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import features as ft, metrics, models
from fieldgauge.operators.ordered import last_n_rows, last_row

VALIDATION_SHARE = 0.2
SCORE_COLUMNS = ("RUL", "predicted_RUL", "failure_probability", "actual_failure_soon")


def training_table(series: DataFrame, columns: Sequence[str], *, unit: str, cycle: str,
                   cap: float = fx.RUL_CAP) -> DataFrame:
    """Labels, raw sensors and trailing means of every cycle."""
    labelled = ft.rul_labels(series, unit, cycle, cap=cap)
    return ft.rolling_features(labelled, columns, unit=unit, cycle=cycle)


def train_baseline(table: DataFrame, columns: Sequence[str], *, unit: str,
                   label: str = "RUL", seed: int = models.SEED,
                   **settings) -> tuple[PipelineModel, DataFrame]:
    """Fit on most units and hand back the model with the rows of the others."""
    train, validation = models.split_by_unit(table, unit, seed=seed)
    model = models.fit_boosted_regressor(train, ft.feature_columns(columns), label, seed=seed,
                                         **settings)
    return model, validation


def unit_sides(unit: str, *, seed: int = models.SEED, test_share: float = models.TEST_SHARE,
               validation_share: float = VALIDATION_SHARE) -> Column:
    """Where a unit belongs: held_out as in ``models.split_by_unit``, and of the others a share
    for validation, the rest for training."""
    return (F.when(models.hash_share(unit, seed) < test_share, "held_out")
            .when(models.hash_share(unit, seed + 1) < validation_share, "validation")
            .otherwise("train"))


def train_validated(table: DataFrame, columns: Sequence[str], *, unit: str, label: str = "RUL",
                    seed: int = models.SEED, **settings) -> tuple[PipelineModel, DataFrame]:
    """Boost until the validation units' error stops falling.

    Returns the model and the table with each row's ``side``. Held-out units neither fit a tree
    nor choose the number of trees, so their error is that of unseen units.
    """
    sided = table.withColumn("side", unit_sides(unit, seed=seed))
    learnt = sided.filter("side != 'held_out'").withColumn(
        "validates", F.col("side") == "validation")
    model = models.fit_boosted_regressor(learnt, ft.feature_columns(columns), label, seed=seed,
                                         validation="validates", **settings)
    return model, sided


def last_cycles(series: DataFrame, columns: Sequence[str], *, unit: str,
                cycle: str) -> DataFrame:
    """Features at the last observed cycle of every unit; earlier rows than its window needs are
    cut before the shuffle."""
    window = last_n_rows(series, [unit], [cycle], ft.WINDOW_ROWS)
    return last_row(ft.rolling_features(window, columns, unit=unit, cycle=cycle),
                    [unit], [cycle])


def with_truth(last: DataFrame, truth: DataFrame, *, unit: str,
               cap: float = fx.RUL_CAP) -> DataFrame:
    """Join the true remaining life of each unit, limited to ``cap``."""
    return last.join(truth, unit).withColumn("RUL", fx.clip("RUL", high=cap))


def score_table(predicted: DataFrame, *, unit: str, cap: float = fx.RUL_CAP,
                horizon: float = fx.FAILURE_HORIZON) -> DataFrame:
    """The exported columns: truth, prediction, failure probability and failure label."""
    return (predicted
            .withColumn("failure_probability", fx.failure_probability("predicted_RUL", cap))
            .withColumn("actual_failure_soon", fx.fails_soon("RUL", horizon))
            .select(unit, *SCORE_COLUMNS))


def evaluate(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Metrics of both sides, in-sample first."""
    both = (train.select(F.lit("in_sample").alias("split"), "RUL", "predicted_RUL")
            .unionByName(held_out.select(F.lit("held_out").alias("split"), "RUL",
                                         "predicted_RUL")))
    return metrics.regression_metrics(both, "RUL", "predicted_RUL", ["split"])


def service_response(model: PipelineModel, history: DataFrame, columns: Sequence[str], *,
                     unit: str, cycle: str, version: str,
                     horizon: float = fx.FAILURE_HORIZON) -> DataFrame:
    """Prediction, alert and model version for every unit of a history table."""
    last = last_cycles(history, columns, unit=unit, cycle=cycle)
    return respond(model, last, unit=unit, cycle=cycle, version=version, horizon=horizon)


def respond(model: PipelineModel, rows: DataFrame, *, unit: str, cycle: str, version: str,
            horizon: float = fx.FAILURE_HORIZON, keep: Sequence[str] = ()) -> DataFrame:
    """The same answer for rows that already carry their features."""
    return models.predict(model, rows).select(
        *keep, unit, cycle, "predicted_RUL", (F.col("predicted_RUL") <= horizon).alias("alert"),
        F.lit(version).alias("model_version"))

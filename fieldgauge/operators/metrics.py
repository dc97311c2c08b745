"""Model quality measures as plain aggregates, grouped when wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.decision import DEFAULT_THRESHOLD, counts_at
from fieldgauge.operators.ordered import SPLIT_ROWS, running_totals, without_nan

# Decay of the penalty for early and late predictions.
EARLY_DECAY, LATE_DECAY = 13.0, 10.0


def late_penalty(truth: str, prediction: str) -> Column:
    """Penalty of one prediction; too much remaining life costs more than too little."""
    diff = (F.col(prediction) - F.col(truth)).cast("double")
    return F.when(diff < 0, F.exp(-diff / EARLY_DECAY) - 1.0).otherwise(
        F.exp(diff / LATE_DECAY) - 1.0)


def regression_metrics(df: DataFrame, truth: str, prediction: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and the late-penalty score in one pass."""
    pairs = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    error = F.col(prediction) - F.col(truth)
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).cast("double").alias("sse"),
        F.sum(F.abs(error)).cast("double").alias("sae"),
        F.var_pop(F.col(truth).cast("double")).alias("var"),
        F.sum(late_penalty(truth, prediction)).alias("late_penalty_score"))
    n = F.col("n").cast("double")
    return sums.select(
        *by, "n",
        F.sqrt(F.try_divide(F.col("sse"), n)).alias("rmse"),
        F.try_divide(F.col("sae"), n).alias("mae"),
        (1.0 - F.try_divide(F.col("sse"), F.col("var") * n)).alias("r2"),
        "late_penalty_score")


def classification_metrics(df: DataFrame, label: str, prob: str, *, by: Sequence[str] = (),
                           threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Precision, recall and F1 at a threshold; zero where the quotient is undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    def quotient(part, whole):
        return F.coalesce(fx.ratio(part, whole), F.lit(0.0))
    return counts_at(df, label, prob, threshold, by=by).select(
        *by, "tp", "fp", "fn", "tn",
        quotient(tp, tp + fp).alias("precision"),
        quotient(tp, tp + fn).alias("recall"),
        quotient(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, label: str, prob: str, by: Sequence[str] = (), *,
            split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with a single class.

    A NaN score counts as the lowest, as it reaches no threshold. Equal scores are summed first. The running count of negatives is split over chunks when
    a group has very many distinct scores.
    """
    by = list(by)
    scored = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).withColumn(
        prob, F.coalesce(without_nan(df, prob), F.lit(float("-inf")))
        if dict(df.dtypes)[prob] in ("double", "float") else F.col(prob))
    positive = (F.col(label) == 1).cast("long")
    ties = scored.groupBy(*by, F.col(prob).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    distinct = (scored.groupBy(*by).agg(F.approx_count_distinct(prob).alias("n"))
                .agg(F.max("n")).first()[0] or 0)
    ranked = running_totals(ties, by, ["score"], {"neg_upto": F.col("neg")},
                            split=distinct > split_rows)
    # Twice the rank sum, in whole numbers: below counts two, a tie counts one.
    wide = "decimal(38,0)"
    twice = F.col("pos").cast(wide) * (2 * F.col("neg_upto") - F.col("neg"))
    return ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(twice.cast(wide)).alias("twice")).select(
        *by, "positives", "negatives",
        F.try_divide(F.col("twice").cast("double"),
                     2.0 * F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


def calibration(df: DataFrame, band: Column, label: str, prob: str) -> DataFrame:
    """Mean predicted probability against the observed rate, by band."""
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("long").alias("positives"),
        fx.ratio(F.sum(label), F.count(label)).alias("observed_rate"),
        fx.ratio(F.sum(prob), F.count(prob)).alias("mean_probability"))

"""Churn reports: profile, churn by dimension, segments, model comparison, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import decision, models


def churn_by(df: DataFrame, dimension: Column, name: str, churned: str) -> DataFrame:
    """Churn rate and customers per value of a dimension."""
    return df.groupBy(dimension.alias(name)).agg(
        fx.ratio(F.sum(churned), F.count(churned)).alias("churn_rate"),
        F.count(churned).alias("customer_count"))


def churn_by_tenure(df: DataFrame, tenure: str, churned: str) -> DataFrame:
    """Churn by tenure bucket in bucket order; tenures outside all buckets are left out."""
    bucket = fx.bin_right_closed(tenure, fx.TENURE_EDGES, fx.TENURE_LABELS)
    return (churn_by(df, bucket, "tenure_bucket", churned)
            .filter(F.col("tenure_bucket").isNotNull())
            .orderBy(fx.bin_ordinal("tenure_bucket", fx.TENURE_LABELS)))


def segments(df: DataFrame, tenure: str, services: str, charge: str, churned: str,
             **options) -> DataFrame:
    """Cluster the customers and describe each segment."""
    clustered = models.segment_customers(df, [tenure, services, charge], **options)
    return models.segment_profile(clustered, "segment", tenure, services, charge, churned)


def model_comparison(df: DataFrame, key: str, label: str, categorical: Sequence[str],
                     numeric: Sequence[str], *, keep: Sequence[str] = (),
                     **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Held-out scores, metrics per model, and the forest's top features."""
    coded = models.encode_labels(df, categorical)
    features = [f"{c}_code" for c in categorical] + list(numeric)
    scores, importance = models.compare_classifiers(coded, key, label, features, keep=keep,
                                                    **options)
    named = importance.withColumn("feature", F.regexp_replace("feature", "_code$", ""))
    return scores, models.model_metrics(scores, label), models.top_features(named)


def retention(scores: DataFrame, metrics: DataFrame, label: str, value: str) -> DataFrame:
    """Retention policies under the better model."""
    chosen = scores.join(models.best_model(metrics), "model", "left_semi")
    return decision.retention_policies(chosen, label, "prob", value)

"""Profiles and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.ordered import first_row


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read NaN as missing, since Spark's averages do not skip NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def agrees(arm: str, exposure: str, pairs: dict[str, str]) -> Column:
    """True when the exposure is the one the arm was meant to see.

    False for a known wrong pair; NULL when either side is missing or unknown, so such rows
    are in neither the clean nor the mismatched set.
    """
    right, wrong = F.lit(False), F.lit(False)
    for own_arm, own_exposure in pairs.items():
        right = right | ((F.col(arm) == own_arm) & (F.col(exposure) == own_exposure))
        for other in pairs.values():
            if other != own_exposure:
                wrong = wrong | ((F.col(arm) == own_arm) & (F.col(exposure) == other))
    return F.when(right, True).when(wrong, False)


def drop_contaminated(df: DataFrame, arm: str, exposure: str,
                      pairs: dict[str, str]) -> DataFrame:
    """Keep rows whose exposure fits their arm."""
    return df.filter(agrees(arm, exposure, pairs))


def clean_experiment(df: DataFrame, by: Sequence[str], user: str, order: Sequence[str],
                     arm: str, exposure: str, pairs: dict[str, str]) -> DataFrame:
    """Contaminated rows out first, then the first row of every user."""
    return first_row(drop_contaminated(df, arm, exposure, pairs), [*by, user], order)


def duplicate_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of every key. Rows with a NULL key are duplicates of each other."""
    sizes = df.groupBy(*by, *[k for k in keys if k not in by]).agg(
        F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def profile_subjects(df: DataFrame, numeric_text: str, outcome: str,
                     yes: str = "Yes") -> DataFrame:
    """Row count, blank numeric texts and base rate in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(fx.is_blank(numeric_text)).alias("blank_total_charges_rows"),
        fx.share_percent(F.sum(fx.yes_flag(outcome, yes)), F.count(F.lit(1)))
        .alias("overall_churn_rate"))


def min_volume(df: DataFrame, count: str, at_least: int) -> DataFrame:
    """Drop aggregate rows that rest on too few observations."""
    return df.filter(F.col(count) >= at_least)


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "input") -> DataFrame:
    """Fail early with a clear message when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks column(s): {', '.join(missing)}")
    return df

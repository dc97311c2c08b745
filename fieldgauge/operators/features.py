"""Features and labels of entity time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.ordered import trailing_mean, with_group_max

# The turbofan inputs that carry a signal, and the window length.
TURBOFAN_FEATURES = ("setting_1", "setting_2", "s_2", "s_3", "s_4", "s_7", "s_8", "s_11",
                     "s_12", "s_13", "s_15")
WINDOW_ROWS = 5


def rul_labels(df: DataFrame, unit: str = "unit_nr", cycle: str = "time_cycles", *,
               cap: float | None = fx.RUL_CAP, out: str = "RUL") -> DataFrame:
    """Remaining life: cycles until the last one of the unit, limited to ``cap``."""
    last = with_group_max(df, [unit], cycle, "__last")
    return (last.withColumn(out, fx.clip(F.col("__last") - F.col(cycle), high=cap))
            .drop("__last"))


def rolling_features(df: DataFrame, columns: Sequence[str] = TURBOFAN_FEATURES, *,
                     unit: str = "unit_nr", cycle: str = "time_cycles",
                     rows: int = WINDOW_ROWS, **split) -> DataFrame:
    """Trailing means of every column beside the raw ones."""
    return trailing_mean(df, [unit], [cycle], columns, rows=rows, **split)


def feature_columns(columns: Sequence[str] = TURBOFAN_FEATURES) -> list[str]:
    """Raw columns followed by their trailing means."""
    return [*columns, *[f"{c}_roll_mean" for c in columns]]


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide sensor columns as (variable, value) rows."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in columns], "variable", "value")

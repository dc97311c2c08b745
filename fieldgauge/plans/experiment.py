"""The experiment verdict: quality, randomisation, test, power and daily trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldgauge.operators import experiment as x

# Digits of the printed figures, rounded half to even.
DIGITS = {"srm_chi2": 4, "srm_p_value": 4, "control_rate": 5, "treatment_rate": 5,
          "absolute_diff": 5, "relative_diff_pct": 2, "z_statistic": 4, "p_value": 4,
          "ci_low": 5, "ci_high": 5, "achieved_power": 4, "minimum_detectable_lift": 5}


def verdict(df: DataFrame, by: Sequence[str] = (), design: x.Design = x.Design()) -> DataFrame:
    """One printed row per experiment."""
    card = x.scorecard(df, by, design)
    return card.withColumns({c: F.bround(c, n) for c, n in DIGITS.items()})

"""Experiment statistics for many experiments in one job.

Everything about an experiment follows from one aggregate per user and one per experiment;
the tests are arithmetic on the resulting row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx, normal
from fieldgauge.operators.quality import agrees

# Fixed values of the tests.
SRM_ALPHA = 0.01
TEST_ALPHA = 0.05
CI_Z = 1.96
TARGET_POWER = 0.80
LIFT_GRID = (0.0001, 0.02, 200)


@dataclass(frozen=True)
class Design:
    """Column names and arm names of an experiment table."""

    user: str = "user_id"
    arm: str = "arm"
    exposure: str = "page"
    outcome: str = "converted"
    order: tuple[str, ...] = ("ts",)
    day: str = "day"
    control: str = "control"
    treatment: str = "treatment"
    pairs: dict[str, str] = field(
        default_factory=lambda: {"control": "old_page", "treatment": "new_page"})


def _per_user(df: DataFrame, by: Sequence[str], d: Design, extra: Sequence[str] = ()) -> DataFrame:
    """One row per user: raw rows, mismatched rows and the first clean row.

    This is the only full-size shuffle of a scorecard. Cleaning before picking the first row
    keeps the order of the two steps: contaminated rows never count as a first row.
    """
    fits = agrees(d.arm, d.exposure, d.pairs)
    ranked = F.struct(*d.order, d.arm, d.outcome, *extra)
    return df.groupBy(*by, d.user).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~fits).alias("mismatched"),
        F.min(F.when(fits, ranked)).alias("first"))


def arm_counts(df: DataFrame, by: Sequence[str] = (), design: Design = Design()) -> DataFrame:
    """Data-quality counts and clean arm counts of every experiment."""
    d = design
    arm, outcome = F.col(f"first.{d.arm}"), F.col(f"first.{d.outcome}").cast("long")
    def converted(name):
        return F.coalesce(F.sum(F.when(arm == name, outcome)), F.lit(0)).cast("long")
    return _per_user(df, by, d).groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("mismatched"), F.lit(0)).alias("mismatched_rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count("first").alias("clean_rows"),
        F.count_if(arm == d.control).alias("n_control"),
        F.count_if(arm == d.treatment).alias("n_treatment"),
        converted(d.control).alias("conversions_control"),
        converted(d.treatment).alias("conversions_treatment"))


def quality_profile(counts: DataFrame) -> DataFrame:
    """Removed rows and percentages beside the quality counts."""
    return counts.withColumns({
        "rows_removed": F.col("raw_rows") - F.col("clean_rows"),
        "mismatched_pct": fx.share_percent(F.col("mismatched_rows"), F.col("raw_rows")),
        "retained_pct": fx.share_percent(F.col("clean_rows"), F.col("raw_rows"))})


def _rates() -> tuple[Column, Column]:
    return (fx.ratio(F.col("conversions_control"), F.col("n_control")),
            fx.ratio(F.col("conversions_treatment"), F.col("n_treatment")))


def srm_check(counts: DataFrame, alpha: float = SRM_ALPHA) -> DataFrame:
    """Chi-square test that both arms have half of the users."""
    expected = (F.col("n_control") + F.col("n_treatment")).cast("double") / 2.0
    chi2 = sum((F.try_divide((F.col(n) - expected) * (F.col(n) - expected), expected)
                for n in ("n_control", "n_treatment")), F.lit(0.0))
    return (counts.withColumns({"expected_per_arm": expected, "srm_chi2": chi2})
            .withColumn("srm_p_value", normal.chi_square_1_tail(F.col("srm_chi2")))
            .withColumn("srm_passed", F.col("srm_p_value") > alpha))


def two_proportion_test(counts: DataFrame, alpha: float = TEST_ALPHA) -> DataFrame:
    """Pooled one-sided z-test (treatment above control) and unpooled interval."""
    p_c, p_t = F.col("control_rate"), F.col("treatment_rate")
    n_c, n_t = F.col("n_control").cast("double"), F.col("n_treatment").cast("double")
    pooled = fx.ratio(F.col("conversions_control") + F.col("conversions_treatment"),
                      F.col("n_control") + F.col("n_treatment"))
    se_pooled = F.sqrt(pooled * (1.0 - pooled)
                       * (F.try_divide(F.lit(1.0), n_c) + F.try_divide(F.lit(1.0), n_t)))
    se = F.sqrt(F.try_divide(p_c * (1.0 - p_c), n_c) + F.try_divide(p_t * (1.0 - p_t), n_t))
    rate_c, rate_t = _rates()
    return (counts.withColumns({"control_rate": rate_c, "treatment_rate": rate_t})
            .withColumn("absolute_diff", p_t - p_c)
            .withColumns({
                "relative_diff_pct": F.try_divide(F.col("absolute_diff"), p_c) * 100.0,
                "z_statistic": F.try_divide(F.col("absolute_diff"), se_pooled),
                "ci_low": F.col("absolute_diff") - CI_Z * se,
                "ci_high": F.col("absolute_diff") + CI_Z * se})
            .withColumn("p_value", normal.upper_tail(F.col("z_statistic")))
            .withColumn("significant", F.col("p_value") < alpha))


def _effect_size(p_from: Column, p_to: Column) -> Column:
    """Cohen's h; NULL where a proportion leaves [0, 1]."""
    h = 2.0 * F.asin(F.sqrt(p_to)) - 2.0 * F.asin(F.sqrt(p_from))
    return F.when(p_to.between(0.0, 1.0) & p_from.between(0.0, 1.0), h)


def achieved_power(counts: DataFrame, alpha: float = TEST_ALPHA) -> DataFrame:
    """Two-sided power to see the observed difference."""
    rate_c, rate_t = _rates()
    n_c, n_t = F.col("n_control").cast("double"), F.col("n_treatment").cast("double")
    spread = F.sqrt(F.try_divide(F.lit(1.0), n_c) + F.try_divide(F.lit(1.0), n_t))
    return (counts.withColumn("effect_size", _effect_size(rate_c, rate_t))
            .withColumn("achieved_power", normal.two_sided_power(
                F.try_divide(F.col("effect_size"), spread), alpha)))


def detectable_lift(counts: DataFrame, alpha: float = TEST_ALPHA, power: float = TARGET_POWER,
                    grid: tuple[float, float, int] = LIFT_GRID) -> DataFrame:
    """The first lift of the grid that two equal arms of control size would detect."""
    rate, _ = _rates()
    needed = normal.shift_for_power(alpha, power)
    scale = F.sqrt(F.col("n_control").cast("double") / 2.0)
    enough = F.filter(fx.double_array(fx.linspace(*grid)),
                      lambda lift: _effect_size(rate, rate + lift) * scale >= needed)
    return counts.withColumn("minimum_detectable_lift", F.get(enough, F.lit(0)))


def scorecard(df: DataFrame, by: Sequence[str] = (), design: Design = Design()) -> DataFrame:
    """Quality, randomisation check, test, power and detectable lift in one row each."""
    counts = quality_profile(arm_counts(df, by, design))
    return detectable_lift(achieved_power(two_proportion_test(srm_check(counts))))


def daily_rates(df: DataFrame, by: Sequence[str] = (), design: Design = Design()) -> DataFrame:
    """Conversion rate by day, one column per arm; NULL on a day without that arm."""
    d = design
    first = _per_user(df, by, d, [d.day]).filter(F.col("first").isNotNull())
    arm, outcome = F.col(f"first.{d.arm}"), F.col(f"first.{d.outcome}")
    aggregates = []
    for name in (d.control, d.treatment):
        hit = F.when(arm == name, outcome)
        aggregates += [fx.ratio(F.sum(hit), F.count(hit)).alias(f"{name}_rate"),
                       F.count(hit).alias(f"{name}_n")]
    return first.groupBy(*by, F.col(f"first.{d.day}").alias("date")).agg(*aggregates)


def daily_pivot(df: DataFrame, by: Sequence[str] = (), design: Design = Design()) -> DataFrame:
    """The same daily rates through a grouped mean and a pivot."""
    d = design
    first = (_per_user(df, by, d, [d.day]).filter(F.col("first").isNotNull())
             .select(*by, "first.*"))
    daily = (first.groupBy(*by, F.col(d.day).alias("date"), F.col(d.arm).alias("arm"))
             .agg(fx.ratio(F.sum(d.outcome), F.count(d.outcome)).alias("rate")))
    wide = daily.groupBy(*by, "date").pivot("arm", [d.control, d.treatment]).agg(F.first("rate"))
    return (wide.withColumnRenamed(d.control, f"{d.control}_rate")
            .withColumnRenamed(d.treatment, f"{d.treatment}_rate"))

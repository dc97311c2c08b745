"""Decision thresholds and what they cost.

A sweep never pairs rows with thresholds. Every row falls into one bucket (the number of
grid points at or below its probability), buckets are summed per group, and the counts at
each threshold are suffix sums over at most one row per grid point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.functions import columns as fx

# Threshold grids of the reports (start, stop, points) and cost figures.
MAINTENANCE_GRID = (0.01, 0.99, 100)
MAINTENANCE_GRID_99 = (0.01, 0.99, 99)
RETENTION_GRID = (0.05, 0.95, 50)
DEFAULT_THRESHOLD = 0.5
OFFER_COST = 100
MONTHS_AT_STAKE = 12


@dataclass(frozen=True)
class FlatCosts:
    """Cost of each outcome of a yes/no decision."""

    true_positive: int = 1500
    false_positive: int = 300
    false_negative: int = 10000
    true_negative: int = 0


def _clean_probability(prob: str) -> Column:
    """NaN and NULL probabilities never reach a threshold."""
    p = F.col(prob).cast("double")
    return F.when(p.isNotNull() & ~F.isnan(p), p)


def points_at_or_below(prob: Column, grid: tuple[float, float, int]) -> Column:
    """How many points of an even grid are <= ``prob``.

    Arithmetic lands within one point of the answer; comparing with the grid values
    themselves settles it, so that ``p >= t`` holds exactly for every point counted.
    """
    start, stop, n = grid
    points = fx.double_array(fx.linspace(start, stop, n))
    step = (stop - start) / (n - 1)
    guess = F.floor((F.least(F.greatest(prob, F.lit(start - step)), F.lit(stop + step)) - start)
                    / step).cast("int") + 1
    low = F.greatest(F.least(guess, F.lit(n)) - 1, F.lit(0))
    def reached(index):
        return F.coalesce(prob >= F.get(points, index), F.lit(False)).cast("int")
    return F.when(prob.isNull(), 0).otherwise(low + reached(low) + reached(low + 1))


def threshold_counts(df: DataFrame, label: str, prob: str, grid: tuple[float, float, int],
                     *, by: Sequence[str] = (), value: str | None = None,
                     also: Sequence[float] = ()) -> DataFrame:
    """Confusion counts at every threshold, deciding yes when ``prob >= threshold``.

    ``also`` adds single thresholds to the grid in the same pass. With ``value``, the summed
    value of all positives and of those that a threshold misses are given too.
    """
    by = list(by)
    even = fx.linspace(*grid)
    extra = [float(t) for t in also if t not in even]
    points = sorted(even + extra)
    n = len(points)
    p = _clean_probability(prob)
    bucket = points_at_or_below(p, grid)
    for t in extra:
        bucket = bucket + F.coalesce(p >= t, F.lit(False)).cast("int")
    positive = (F.col(label) == 1).cast("long")
    measures = {"n": F.count(F.lit(1)), "pos": F.sum(F.coalesce(positive, F.lit(0)))}
    if value is not None:
        measures["val"] = F.coalesce(F.sum(F.when(F.col(label) == 1, F.col(value))), F.lit(0))
    buckets = (df.withColumn("bucket", bucket).groupBy(*by, "bucket")
               .agg(*[c.alias(k) for k, c in measures.items()]))

    # At most one row per threshold and group from here on.
    whole = Window.partitionBy(*by)
    downward = Window.partitionBy(*by).orderBy(F.col("bucket").desc())
    upto = downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = buckets.select(
        *by, "bucket",
        F.lag("bucket", 1, n).over(downward).alias("next_bucket"),
        F.lead("bucket").over(downward).isNull().alias("lowest"),
        *[F.sum(k).over(whole).alias(f"{k}_all") for k in measures],
        *[(F.sum(k).over(upto) - F.col(k)).alias(f"{k}_above") for k in measures])
    # A bucket serves the thresholds between itself and the next one above; the lowest also
    # serves those below it, where every row is a yes.
    first = F.when(F.col("lowest"), F.lit(1)).otherwise(F.col("bucket") + 1)
    served = F.when(first <= F.col("next_bucket"), F.sequence(first, F.col("next_bucket")))
    rows = runs.withColumn("point", F.explode(served))
    above = F.col("point") > F.col("bucket")
    yes = {k: F.when(above, F.col(f"{k}_above")).otherwise(F.col(f"{k}_all")) for k in measures}
    return rows.select(
        *by, F.get(fx.double_array(points), F.col("point") - 1).alias("threshold"),
        yes["pos"].alias("tp"),
        (yes["n"] - yes["pos"]).alias("fp"),
        (F.col("pos_all") - yes["pos"]).alias("fn"),
        (F.col("n_all") - yes["n"] - F.col("pos_all") + yes["pos"]).alias("tn"),
        *([(F.col("val_all") - yes["val"]).alias("missed_value"),
           F.col("val_all").alias("value_at_stake")] if value else []))


def counts_at(df: DataFrame, label: str, prob: str, threshold: float, *,
              by: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """The same counts at a single threshold."""
    yes = F.coalesce(_clean_probability(prob) >= threshold, F.lit(False))
    truth = F.coalesce(F.col(label) == 1, F.lit(False))
    aggregates = [F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"),
                  F.count_if(~yes & truth).alias("fn"), F.count_if(~yes & ~truth).alias("tn")]
    if value is not None:
        aggregates.append(F.coalesce(F.sum(F.when(~yes & truth, F.col(value))), F.lit(0))
                          .alias("missed_value"))
    out = df.groupBy(*by).agg(*aggregates)
    return out.withColumn("threshold", F.lit(float(threshold)))


def with_flat_cost(counts: DataFrame, costs: FlatCosts = FlatCosts()) -> DataFrame:
    return counts.withColumn("total_cost", (
        F.col("tp") * costs.true_positive + F.col("fp") * costs.false_positive
        + F.col("fn") * costs.false_negative + F.col("tn") * costs.true_negative))


def with_value_cost(counts: DataFrame, offer_cost: float = OFFER_COST) -> DataFrame:
    """An offer for every predicted positive plus the value of every missed one."""
    return counts.withColumn(
        "total_cost", (F.col("tp") + F.col("fp")) * offer_cost + F.col("missed_value"))


def with_reactive_savings(counts: DataFrame, costs: FlatCosts = FlatCosts()) -> DataFrame:
    """Savings against letting every positive fail."""
    return counts.withColumn("savings_vs_reactive", (
        (F.col("tp") + F.col("fn")) * costs.false_negative - F.col("total_cost")))


def optimal_threshold(costed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cheapest row of every group; the lowest threshold wins a tie."""
    best = costed.groupBy(*by).agg(F.min_by(
        F.struct(*[c for c in costed.columns if c not in by]),
        F.struct("total_cost", "threshold")).alias("best"))
    return best.select(*by, "best.*")


# The names that the reports give the policies.
POLICY_NAMES = ("Run-To-Failure (Reactive)", "Standard Model", "Cost-Optimized Model")
RETENTION_NAMES = ("No Program", "Standard Threshold", "Optimized Threshold")


def _policies(costed: DataFrame, cost_of_none: Column, names: Sequence[str],
              grid: tuple[float, float, int], by: Sequence[str]) -> DataFrame:
    """Three rows per group out of a costed sweep: no model, 0.50 and the cheapest threshold."""
    columns = ("threshold", "fn", "fp", "total_cost")
    row = F.struct(*columns)
    default = F.col("threshold") == DEFAULT_THRESHOLD
    on_grid = F.lit(True) if DEFAULT_THRESHOLD in fx.linspace(*grid) else ~default
    cost_type = dict(costed.dtypes)["total_cost"]
    none = F.struct(F.lit(None).cast("double").alias("threshold"),
                    (F.col("tp") + F.col("fn")).alias("fn"),
                    F.lit(0).cast("long").alias("fp"),
                    cost_of_none.cast(cost_type).alias("total_cost"))
    picked = costed.groupBy(*by).agg(
        F.max(F.when(default, none)).alias("none"),
        F.max(F.when(default, row)).alias("default"),
        F.min_by(F.when(on_grid, row),
                 F.when(on_grid, F.struct("total_cost", "threshold"))).alias("best"))
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("strategy"),
                               *[F.col(f"{part}.{c}").alias(c) for c in columns])
                      for i, (part, name) in enumerate(
                          zip(("none", "default", "best"), names, strict=True), start=1)])
    return picked.select(*by, "none", "default", F.explode(table).alias("p")).select(
        *by, "p.*",
        (F.col("none.total_cost") - F.col("p.total_cost")).alias("savings_vs_none"),
        (F.col("default.total_cost") - F.col("p.total_cost")).alias("savings_vs_default"))


def maintenance_policies(df: DataFrame, label: str, prob: str, *, by: Sequence[str] = (),
                         grid: tuple[float, float, int] = MAINTENANCE_GRID,
                         costs: FlatCosts = FlatCosts()) -> DataFrame:
    """Run to failure, the 0.50 cut-off and the cheapest cut-off side by side, in one pass."""
    costed = with_flat_cost(threshold_counts(df, label, prob, grid, by=by,
                                             also=[DEFAULT_THRESHOLD]), costs)
    failures = (F.col("tp") + F.col("fn")) * costs.false_negative
    return _policies(costed, failures, POLICY_NAMES, grid, by)


def retention_policies(df: DataFrame, label: str, prob: str, value: str, *,
                       by: Sequence[str] = (), grid: tuple[float, float, int] = RETENTION_GRID,
                       offer_cost: float = OFFER_COST) -> DataFrame:
    """No offers, the 0.50 cut-off and the cheapest cut-off, each customer at their own value."""
    counts = threshold_counts(df, label, prob, grid, by=by, value=value,
                              also=[DEFAULT_THRESHOLD])
    return _policies(with_value_cost(counts, offer_cost), F.col("value_at_stake"),
                     RETENTION_NAMES, grid, by)

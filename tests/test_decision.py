import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import decision as dc

GRID = dc.MAINTENANCE_GRID
POINTS = fx.linspace(*GRID)


def brute(rows, grid):
    out = {}
    for t in grid:
        yes = [(p is not None and p == p and p >= t, y, v) for y, p, v in rows]
        out[t] = (sum(a and y == 1 for a, y, _ in yes), sum(a and y == 0 for a, y, _ in yes),
                  sum(not a and y == 1 for a, y, _ in yes),
                  sum(not a and y == 0 for a, y, _ in yes),
                  sum(v for a, y, v in yes if not a and y == 1))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    on_points = [(r.randrange(2), p, r.randrange(100)) for p in POINTS]
    near = [(r.randrange(2), p + d, 1) for p in POINTS for d in (-1e-15, 1e-15)]
    other = [(r.randrange(2), r.random() * 1.4 - 0.2, r.randrange(50)) for _ in range(300)]
    return on_points + near + other + [(1, None, 7), (0, float("nan"), 3), (1, float("inf"), 2),
                                       (1, float("-inf"), 5)]


def frame(spark, rows, group="g"):
    return spark.createDataFrame([(group, *r) for r in rows], "g string, y int, p double, v long")


def got(df):
    return {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["missed_value"])
            for r in df.collect()}


@pytest.mark.parametrize("grid", [GRID, dc.MAINTENANCE_GRID_99, dc.RETENTION_GRID])
def test_sweep_equals_pairing_rows_with_thresholds(spark, rows, grid):
    df = frame(spark, rows)
    assert got(dc.threshold_counts(df, "y", "p", grid, value="v")) == brute(
        rows, fx.linspace(*grid))


def test_sweep_by_group_covers_every_threshold(spark, rows):
    groups = {"all": rows, "none": [(0, None, 1)], "top": [(1, 1.0, 4)], "low": [(0, 0.0, 1)],
              "mid": [(1, 0.5, 2), (0, 0.5, 2)]}
    df = None
    for name, content in groups.items():
        part = frame(spark, content, name)
        df = part if df is None else df.unionByName(part)
    swept = dc.threshold_counts(df, "y", "p", GRID, by=["g"], value="v")
    for name, content in groups.items():
        assert got(swept.filter(F.col("g") == name)) == brute(content, POINTS)


def test_counts_sum_to_the_rows(spark, rows):
    swept = dc.threshold_counts(frame(spark, rows), "y", "p", GRID)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    assert [r[0] for r in swept.select(total).distinct().collect()] == [len(rows)]


def test_cheapest_threshold_is_the_lowest_on_ties(spark):
    df = frame(spark, [(1, 0.9, 1), (0, 0.2, 1)])
    best = dc.optimal_threshold(dc.with_flat_cost(dc.threshold_counts(df, "y", "p", GRID)))
    row = best.first()
    assert row["total_cost"] == 1500
    assert row["threshold"] == min(t for t in POINTS if t > 0.2)


def test_single_thresholds_join_the_grid(spark, rows):
    more = [0.5, 0.123, POINTS[7]]
    df = frame(spark, rows)
    assert got(dc.threshold_counts(df, "y", "p", GRID, value="v", also=more)) == brute(
        rows, sorted({*POINTS, *more}))


def test_the_default_is_no_candidate_for_the_best(spark):
    # 0.50 alone separates these; it is not on the grid, so the best grid point costs more.
    df = frame(spark, [(0, 0.4999, 1), (1, 0.5, 1)])
    table = {r["rank"]: r for r in dc.maintenance_policies(df, "y", "p").collect()}
    assert table[2]["total_cost"] == 1500 and table[3]["total_cost"] == 1800
    assert dc.optimal_threshold(dc.with_flat_cost(
        dc.threshold_counts(df, "y", "p", GRID))).first()["total_cost"] == 1800


def test_policies(spark):
    df = frame(spark, [(1, 0.9, 120), (1, 0.4, 240), (0, 0.6, 360), (0, 0.1, 480)])
    flat = {r["rank"]: r for r in dc.maintenance_policies(df, "y", "p").collect()}
    assert [flat[i]["total_cost"] for i in (1, 2, 3)] == [20000, 11800, 3300]
    assert flat[3]["savings_vs_none"] == 16700 and flat[3]["savings_vs_default"] == 8500
    value = {r["rank"]: r for r in dc.retention_policies(df, "y", "p", "v").collect()}
    assert [value[i]["total_cost"] for i in (1, 2, 3)] == [360, 440, 300]


def test_above_every_probability_costs_the_baseline(spark):
    df = frame(spark, [(1, 0.2, 10), (1, 0.3, 30), (0, 0.1, 5)])
    swept = dc.with_value_cost(dc.threshold_counts(df, "y", "p", GRID, value="v"))
    assert {r["total_cost"] for r in swept.filter("threshold > 0.3").collect()} == {40}


def test_one_class_and_empty(spark):
    none = frame(spark, [(0, 0.4, 1)])
    assert {r["fn"] for r in dc.threshold_counts(none, "y", "p", GRID).collect()} == {0}
    assert dc.threshold_counts(none.filter("false"), "y", "p", GRID).count() == 0


def test_no_row_is_paired_with_the_grid(spark, rows):
    df = dc.threshold_counts(frame(spark, rows), "y", "p", GRID, by=["g"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.index("Generate") < plan.index("Aggregate")  # exploded after aggregating

"""The split paths give what the plain windows give, also for one entity with most rows."""

import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(7)
    rows = [("hot" if i % 3 else f"u{r.randrange(9)}", r.randrange(40), i,
             r.randrange(10000) / 100) for i in range(1500)]
    rows += [(None, r.randrange(5), 2000 + i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "unit string, t long, id long, v double")
    return df.withColumn("v", F.col("v").cast("decimal(18,2)")).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_unit(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        out.setdefault(r["unit"], []).append(r)
    return out


@pytest.mark.parametrize("split_rows", [10, 200, 10 ** 6])
def test_positions(spark, series, split_rows):
    got = ordered.row_position(series, ["unit"], ["t", "id"], split_rows=split_rows)
    want = {r["id"]: i for rs in by_unit(series.collect()).values()
            for i, r in enumerate(rs, start=1)}
    assert {r["id"]: r["position"] for r in got.collect()} == want


@pytest.mark.parametrize("split_rows,block_rows", [(10, 5), (10, 7), (200, 100)])
def test_trailing_mean_split_equals_plain(spark, series, split_rows, block_rows):
    plain = ordered.trailing_mean(series, ["unit"], ["t", "id"], ["v"])
    split = ordered.trailing_mean(series, ["unit"], ["t", "id"], ["v"], split_rows=split_rows,
                                  block_rows=block_rows)
    assert split.columns == plain.columns
    assert rows_of(split) == rows_of(plain)
    for rs in by_unit(plain.collect()).values():
        for i, r in enumerate(rs):
            window = [float(x["v"]) for x in rs[max(0, i - 4):i + 1]]
            assert r["v_roll_mean"] == pytest.approx(sum(window) / len(window))


def test_block_must_hold_the_window(series):
    with pytest.raises(ValueError):
        ordered.trailing_mean(series, ["unit"], ["t", "id"], ["v"], split_rows=10, block_rows=4)


def test_only_hot_entities_are_set_apart(spark, series):
    normal, hot = ordered.split_off_hot(series, ["unit"], 200)
    assert {r["unit"] for r in hot.select("unit").distinct().collect()} == {"hot"}
    assert normal.count() + hot.count() == series.count()
    assert normal.filter("unit IS NULL").count() == 30
    normal, hot = ordered.split_off_hot(series, ["unit"], 10)
    assert normal.count() == 0 and hot.filter("unit IS NULL").count() == 30


def test_positions_without_keys(spark, series):
    got = ordered.row_position(series, [], ["id"], split_rows=10).collect()
    assert [r["position"] for r in sorted(got, key=lambda r: r["id"])] == list(
        range(1, len(got) + 1))


def test_running_totals_without_keys(spark, series):
    plain = ordered.running_totals(series, [], ["id"], {"total": F.col("v")}, split=False)
    split = ordered.running_totals(series, [], ["id"], {"total": F.col("v")}, split=True)
    assert rows_of(split) == rows_of(plain)


def test_last_and_first_rows(spark, series):
    groups = by_unit(series.collect())
    last = {(r["unit"], r["id"]) for r in
            ordered.last_n_rows(series, ["unit"], ["t", "id"], 20).collect()}
    assert last == {(u, r["id"]) for u, rs in groups.items() for r in rs[-20:]}
    newest = {r["unit"]: r["id"] for r in
              ordered.last_row(series, ["unit"], ["t", "id"]).collect()}
    assert newest == {u: rs[-1]["id"] for u, rs in groups.items()}
    first = {r["unit"]: r["id"] for r in
             ordered.first_row(series, ["unit"], ["t", "id"]).collect()}
    assert first == {u: rs[0]["id"] for u, rs in groups.items()}


@pytest.mark.parametrize("limit", [1, 10 ** 6])
def test_group_max(spark, series, limit, monkeypatch):
    monkeypatch.setattr(ordered.broadcast_if_small, "__defaults__", (limit,))
    got = {(r["unit"], r["m"]) for r in
           ordered.with_group_max(series, ["unit"], "t", "m").collect()}
    want = {(u, None if u is None else rs[-1]["t"])
            for u, rs in by_unit(series.collect()).items()}
    assert got == want


def test_group_limit_runs_before_the_shuffle(spark, series):
    for df in (ordered.last_n_rows(series, ["unit"], ["t", "id"], 20),
               ordered.first_row(series, ["unit"], ["t", "id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning(unit"):]
        assert "WindowGroupLimit" in below


def test_empty_input(spark, series):
    none = series.filter("id < 0")
    assert ordered.trailing_mean(none, ["unit"], ["t", "id"], ["v"]).count() == 0
    assert ordered.row_position(none, ["unit"], ["t", "id"]).count() == 0

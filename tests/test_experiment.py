import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import experiment as x, quality
from fieldgauge.plans import experiment as plan

PAIRS = {"control": "old_page", "treatment": "new_page"}
DESIGN = x.Design(order=("ts",))
SCHEMA = "e string, user_id long, ts long, arm string, page string, converted int, day string"


def counts(spark, n_c, n_t, c_c, c_t):
    return spark.createDataFrame([("a", n_c, n_t, c_c, c_t)],
                                 "e string, n_control long, n_treatment long, "
                                 "conversions_control long, conversions_treatment long")


def test_published_figures(spark):
    """Arm counts and figures of the published landing-page test."""
    df = counts(spark, 145274, 145310, 17489, 17264)
    r = x.detectable_lift(x.achieved_power(x.two_proportion_test(x.srm_check(df)))).first()
    assert round(r["srm_chi2"], 4) == 0.0045 and round(r["srm_p_value"], 4) == 0.9468
    assert r["srm_passed"] and r["expected_per_arm"] == 145292
    assert (round(r["control_rate"], 5), round(r["treatment_rate"], 5)) == (0.12039, 0.11881)
    assert round(r["absolute_diff"], 5) == -0.00158
    assert round(r["relative_diff_pct"], 2) == -1.31
    assert round(r["z_statistic"], 4) == -1.3109 and round(r["p_value"], 4) == 0.9051
    assert (round(r["ci_low"], 5), round(r["ci_high"], 5)) == (-0.00394, 0.00078)
    assert not r["significant"]
    assert round(r["achieved_power"], 4) == 0.2587
    assert round(r["minimum_detectable_lift"], 5) == 0.0035


def test_empty_arm_gives_null_figures(spark):
    r = x.detectable_lift(x.achieved_power(x.two_proportion_test(
        x.srm_check(counts(spark, 0, 10, 0, 3))))).first()
    assert r["control_rate"] is None and r["z_statistic"] is None and r["p_value"] is None
    assert r["achieved_power"] is None and r["minimum_detectable_lift"] is None
    assert r["srm_p_value"] < 0.01 and not r["srm_passed"]


def test_no_lift_is_large_enough(spark):
    assert x.detectable_lift(counts(spark, 20, 20, 5, 5)).first()[
        "minimum_detectable_lift"] is None


@pytest.fixture(scope="module")
def visits(spark):
    r = random.Random(11)
    rows = []
    for i in range(900):
        user = 1 if i % 3 == 0 else r.randrange(2, 300)  # one user sends a third of all rows
        arm = ["control", "treatment"][r.randrange(2)]
        page = PAIRS[arm] if r.random() < 0.9 else r.choice(["old_page", "new_page", "other"])
        rows.append(("xy"[i % 2], user, i, arm, page, r.randrange(2), f"d{i % 4}"))
    rows += [("x", None, 5000, "control", "old_page", 1, "d0"),
             ("x", None, 5001, "control", "old_page", 0, "d0"),
             ("x", 400, 5002, None, "old_page", 0, "d0")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clean_by_hand(rows):
    """Wrong pages out, then the first row of each user, in that order."""
    seen, kept = set(), []
    for r in sorted(rows, key=lambda r: r["ts"]):
        if r["arm"] and PAIRS[r["arm"]] == r["page"] and r["user_id"] not in seen:
            seen.add(r["user_id"])
            kept.append(r)
    return kept


def test_counts_equal_cleaning_by_hand(spark, visits):
    rows = visits.collect()
    for r in x.arm_counts(visits, ["e"], DESIGN).collect():
        mine = [v for v in rows if v["e"] == r["e"]]
        kept = clean_by_hand(mine)
        assert r["raw_rows"] == len(mine) and r["clean_rows"] == len(kept)
        assert r["duplicate_rows"] == len(mine) - len({v["user_id"] for v in mine})
        assert r["mismatched_rows"] == sum(
            (v["arm"], v["page"]) in {("control", "new_page"), ("treatment", "old_page")}
            for v in mine)
        for arm in PAIRS:
            assert r[f"n_{arm}"] == sum(v["arm"] == arm for v in kept)
            assert r[f"conversions_{arm}"] == sum(
                v["converted"] for v in kept if v["arm"] == arm)


def test_row_level_cleaning_is_idempotent(spark, visits):
    def clean(df):
        return quality.clean_experiment(df, ["e"], "user_id", ["ts"], "arm", "page", PAIRS)
    once = clean(visits)
    ids = sorted(r["ts"] for r in once.collect())
    by_hand = [r["ts"] for e in "xy"
               for r in clean_by_hand([v for v in visits.collect() if v["e"] == e])]
    assert ids == sorted(by_hand)
    assert sorted(r["ts"] for r in clean(once).collect()) == ids


def test_daily_rates_equal_the_pivot(spark, visits):
    wide = x.daily_rates(visits, ["e"], DESIGN).select(
        "e", "date", "control_rate", "treatment_rate")
    pivot = x.daily_pivot(visits, ["e"], DESIGN)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, pivot.collect()))


def test_day_without_an_arm_is_null(spark):
    df = spark.createDataFrame([("x", 1, 1, "control", "old_page", 1, "d")], SCHEMA)
    r = x.daily_rates(df, [], DESIGN).first()
    assert r["control_rate"] == 1.0 and r["treatment_rate"] is None


def test_scorecard_takes_one_full_shuffle(spark, visits):
    plan_text = x.scorecard(visits, ["e"], DESIGN)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning(e") == 2  # per user, then per experiment
    assert "Join" not in plan_text


def test_verdict_rounds(spark, visits):
    r = plan.verdict(visits, [], DESIGN).first()
    assert r["z_statistic"] == round(r["z_statistic"], 4)
    assert r["rows_removed"] == r["raw_rows"] - r["clean_rows"]


def test_duplicates_and_profile(spark, visits):
    assert quality.duplicate_rows(visits, ["user_id"]).first()[0] == (
        visits.count() - len({r["user_id"] for r in visits.collect()}))
    df = spark.createDataFrame([(" ", "Yes"), ("1", "No"), (None, None)], "t string, y string")
    p = quality.profile_subjects(df, "t", "y").first()
    assert (p[0], p[1]) == (3, 1) and p[2] == pytest.approx(100 / 3)


def test_nan_is_read_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert quality.nan_to_null(df, ["v"]).agg(F.avg("v")).first()[0] == 1.0

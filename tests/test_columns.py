import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import columns as fx, normal


def one(spark, expression, **values):
    row = spark.range(1).select(*[
        (v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()] or ["id"])
    return row.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("value,label", [
    (-1, None), (0, "0-12 mo"), (12, "0-12 mo"), (13, "13-24 mo"), (24, "13-24 mo"),
    (25, "25-48 mo"), (48, "25-48 mo"), (49, "49+ mo"), (100, "49+ mo"), (101, None)])
def test_bins_are_right_closed(spark, value, label):
    assert one(spark, fx.bin_right_closed("v", fx.TENURE_EDGES, fx.TENURE_LABELS),
               v=value) == label


def test_bin_of_null(spark):
    null = F.lit(None).cast("int")
    assert one(spark, fx.bin_right_closed("v", fx.TENURE_EDGES, fx.TENURE_LABELS), v=null) is None


@pytest.mark.parametrize("text,number", [("", 0.0), ("   ", 0.0), (" 12.5 ", 12.5), (None, None)])
def test_blank_to_zero(spark, text, number):
    assert one(spark, fx.blank_to_zero("t"), t=F.lit(text).cast("string")) == number


def test_count_yes_skips_null_and_other_texts(spark):
    got = one(spark, fx.count_yes(["a", "b", "c", "d"]), a="Yes", b="No",
              c="No internet service", d=F.lit(None).cast("string"))
    assert got == 1


def test_clip_keeps_null(spark):
    assert one(spark, fx.clip("v", 0.0, 125.0), v=F.lit(None).cast("double")) is None
    assert one(spark, fx.clip("v", 0.0, 125.0), v=130.0) == 125.0
    assert one(spark, fx.clip("v", 0.0, 125.0), v=-1.0) == 0.0


def test_failure_probability_and_horizon(spark):
    assert one(spark, fx.failure_probability("p"), p=120.54419198432203) == pytest.approx(
        0.03564646412542383, abs=1e-15)
    assert one(spark, fx.failure_probability("p"), p=-3.0) == 1.0
    assert one(spark, fx.failure_probability("p"), p=140.0) == 0.0
    assert one(spark, fx.fails_soon("r"), r=20) == 1
    assert one(spark, fx.fails_soon("r"), r=21) == 0


@pytest.mark.parametrize("health,temp,torque,status", [
    (75.0, 302.0, 60.0, fx.NORMAL), (74.9, 302.0, 60.0, fx.WARNING),
    (50.0, 302.0, 60.0, fx.WARNING), (49.9, 0.0, 0.0, fx.FAILURE_IMMINENT),
    (99.0, 302.1, 0.0, fx.FAILURE_IMMINENT), (99.0, 0.0, 60.1, fx.FAILURE_IMMINENT)])
def test_limits_are_strict(spark, health, temp, torque, status):
    assert one(spark, fx.equipment_status("h", "t", "q"), h=health, t=temp, q=torque) == status


def test_delivery_on_the_estimate_is_on_time(spark):
    at = F.lit("2020-01-02 10:00:00").cast("timestamp")
    assert one(spark, fx.delivery_status("d", "e"), d=at, e=at) == fx.ON_TIME
    assert one(spark, fx.late_flag("d", "e"), d=F.lit(None).cast("timestamp"), e=at) == 0


def test_days_count_midnights(spark):
    a = F.lit("2020-01-01 23:59:00").cast("timestamp")
    z = F.lit("2020-01-02 00:01:00").cast("timestamp")
    assert one(spark, fx.days_between("a", "z"), a=a, z=z) == 1


@pytest.mark.parametrize("rate,tenure,charge,label", [
    (0.36, 50.0, 90.0, "New & At-Risk"), (0.35, 41.0, 71.0, "Loyal High-Value"),
    (0.1, 41.0, 70.0, "Loyal Low-Spend"), (0.1, 40.0, 90.0, "New Low-Engagement")])
def test_segment_label(spark, rate, tenure, charge, label):
    assert one(spark, fx.segment_label("r", "t", "c"), r=rate, t=tenure, c=charge) == label


def test_tags_and_texts(spark):
    assert one(spark, fx.delivery_risk_tag("d"), d=14.0) == "Healthy"
    assert one(spark, fx.delivery_risk_tag("d"), d=14.1) == "High Delivery Time"
    assert [one(spark, fx.risk_tier("r"), r=r) for r in (0.31, 0.30, 0.15)] == [
        "risky", "mid", "safe"]
    assert one(spark, fx.display_label("t"), t="credit_card_x") == "credit card_x"
    assert one(spark, fx.whole_text("v"), v=15491111.16) == "15,491,111"
    assert one(spark, fx.fixed_text("v", 2), v=139.754) == "139.75"
    assert one(spark, fx.first_known("a", "b"), a=F.lit(None).cast("string"),
               b=F.lit(None).cast("string")) == "unknown"


def test_grid_ends_are_exact():
    grid = fx.linspace(0.01, 0.99, 100)
    assert (grid[0], grid[-1], len(grid)) == (0.01, 0.99, 100)
    assert all(a < b for a, b in zip(grid, grid[1:]))


def test_normal_tail(spark):
    assert one(spark, normal.upper_tail("x"), x=1.959963984540054) == pytest.approx(0.025)
    assert one(spark, normal.upper_tail("x"), x=F.lit(None).cast("double")) is None
    shift = normal.shift_for_power(0.05, 0.8)
    assert shift == pytest.approx(2.80158, abs=1e-5)
    assert one(spark, normal.two_sided_power("x", 0.05), x=shift) == pytest.approx(0.8)
    assert one(spark, normal.chi_square_1_tail("x"), x=3.841458820694124) == pytest.approx(0.05)

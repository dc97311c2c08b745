"""Scans read only what a query needs, and nothing is paired with everything."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = entry.queries()["kpis"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in text


BATCH = ["kpis", "category_risk", "state_performance", "delivery_vs_reviews", "late_rate_trend",
         "revenue_late_trend", "late_effect", "payment_breakdown", "experiment_profile",
         "experiment_mde", "experiment_daily_pivot", "rul_labels", "rolling_features",
         "last_n_buffer", "regression_metrics", "threshold_sweep_by_fleet",
         "retention_policies", "policy_comparison", "churn_by_bucket", "stratified_split_exact"]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_level_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan


def test_tail_functions_need_no_python(spark):
    for name in ("experiment_srm", "experiment_ztest", "experiment_power", "experiment_verdict"):
        assert "Python" not in plan_of(spark, name)


def test_features_of_many_columns_share_one_sort(spark):
    from fieldgauge import bindings
    from fieldgauge.operators import features
    rows = bindings.engine_rows(spark, SF)
    df = features.rolling_features(rows, ["s_1", "s_2", "s_3"], unit="unit", cycle="event_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(unit") == 1 and text.count("Sort [") == 1

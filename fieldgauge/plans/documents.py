"""Whole reports as one JSON document each, figures rounded as printed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators import decision, experiment as x, models, quality
from fieldgauge.plans import churn, experiment as xp, marketplace as m
from fieldgauge.session import shared_dir
from fieldgauge.sources.writers import records, report_document

# The subscriber table's columns and the digits of the churn figures.
SERVICE_COLUMNS = ("PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                   "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")
CATEGORY_COLUMNS = ("gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
                    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                    "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
                    "PaperlessBilling", "PaymentMethod")
NUMBER_COLUMNS = ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "num_services")
CHURN_DIGITS = {"overall_churn_rate": 2, "churn_rate": 3, "auc": 3, "precision": 3, "recall": 3,
                "f1": 3, "threshold": 3, "cost": 2}
AB_DESIGN = x.Design(user="user_id", arm="group", exposure="landing_page", outcome="converted",
                     order=("timestamp",), day="date")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def marketplace_document(spark: SparkSession, tables: Mapping[str, DataFrame], *,
                         min_category: int = m.MIN_CATEGORY_ORDERS,
                         min_state: int = m.MIN_STATE_ORDERS,
                         undefined_payment: str = m.UNDEFINED_PAYMENT,
                         delivered: str = m.DELIVERED, minor_units: int = 1) -> DataFrame:
    """The seven marketplace reports, from tables as ``report_inputs`` names them."""
    orders, items, reviews = tables["orders"], tables["order_items"], tables["reviews"]
    only = {"delivered": delivered}
    money = {**only, "minor_units": minor_units}
    category = _renamed(
        m.rounded(m.category_risk(orders, items, tables["products"],
                                  tables["category_translation"], reviews,
                                  min_orders=min_category, **money)),
        category="category", revenue="revenue", orders="order_count", late_pct="late_pct",
        avg_score="avg_review_score")
    state = _renamed(
        m.rounded(m.state_performance(orders, items, tables["customers"], reviews,
                                      min_orders=min_state, **money)),
        state="state", revenue="revenue", orders="order_count",
        avg_delivery_days="avg_delivery_days", avg_score="avg_review_score")
    status = _renamed(m.rounded(m.delivery_vs_reviews(orders, reviews, **only)),
                      status="delivery_status", avg_score="avg_review_score",
                      count="order_count")
    payment = _renamed(
        m.rounded(m.payment_breakdown(tables["payments"], undefined_payment,
                                      minor_units=minor_units)),
        type="payment_type", count="payments", avg_installments="avg_installments",
        total_value="total_value")
    return report_document(spark, "marketplace", {
        "kpis": m.rounded(m.kpis(orders, items, reviews, **money)),
        "monthly_revenue": records(m.rounded(m.monthly_revenue(orders, items, **money)),
                                   ["month"]),
        "delivery_vs_reviews": records(status, [-F.col("avg_score"), "status"]),
        "late_rate_trend": records(m.rounded(m.late_rate_trend(orders, **only)), ["month"]),
        "category_risk": records(category, [-F.col("revenue"), "category"]),
        "state_performance": records(state, [-F.col("revenue"), "state"]),
        "payment_breakdown": records(payment, [-F.col("total_value"), "type"])})


def experiment_document(visits: DataFrame, design: x.Design = AB_DESIGN) -> DataFrame:
    """The verdict of one experiment in four sections, and its daily rates."""
    card = xp.verdict(visits, [], design)
    daily = x.daily_rates(visits, [], design).select("date", f"{design.control}_rate",
                                                     f"{design.treatment}_rate")
    def section(**names: str | Column) -> Column:
        return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n)
                          for n, c in names.items()])
    sections = {
        "data_quality": section(
            raw_rows="raw_rows", mismatched_assignment_rows="mismatched_rows",
            duplicate_user_id_rows="duplicate_rows", rows_after_cleaning="clean_rows",
            rows_removed="rows_removed"),
        "srm_check": section(n_control="n_control", n_treatment="n_treatment",
                             chi2="srm_chi2", p_value="srm_p_value", passed="srm_passed"),
        "main_test": section(
            control_conversions="conversions_control", control_n="n_control",
            control_rate="control_rate", treatment_conversions="conversions_treatment",
            treatment_n="n_treatment", treatment_rate="treatment_rate",
            absolute_diff="absolute_diff", relative_diff_pct="relative_diff_pct",
            z_statistic="z_statistic", p_value="p_value", ci_95_low="ci_low",
            ci_95_high="ci_high", significant_at_05="significant"),
        "power_analysis": section(
            achieved_power_for_observed_effect="achieved_power",
            minimum_detectable_lift_at_80pct_power="minimum_detectable_lift"),
        "daily_trend": records(daily, ["date"]).scalar()}
    body = F.struct(*[c.alias(name) for name, c in sections.items()])
    return card.select(F.lit("experiment").alias("report"),
                       F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def prepared_subscribers(df: DataFrame) -> DataFrame:
    """Numbers out of the subscriber table's texts."""
    return (df.withColumn("blank_text", F.col("TotalCharges"))
            .withColumn("TotalCharges", fx.blank_to_zero("TotalCharges"))
            .withColumn("churned", fx.yes_flag("Churn"))
            .withColumn("num_services", fx.count_yes(SERVICE_COLUMNS))
            .withColumn("at_stake", (F.col("MonthlyCharges") * decision.MONTHS_AT_STAKE)
                        .cast("decimal(20,2)")))


def _printed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.bround(c, n) for c, n in CHURN_DIGITS.items()
                           if c in df.columns})


def churn_document(subjects: DataFrame, *, key: str = "customerID", contract: str = "Contract",
                   tenure: str = "tenure", services: str = "num_services",
                   charge: str = "MonthlyCharges", churned: str = "churned",
                   at_stake: str = "at_stake", blank_text: str = "blank_text",
                   outcome: str = "Churn", categorical: Sequence[str] = CATEGORY_COLUMNS,
                   numeric: Sequence[str] = NUMBER_COLUMNS, segment_options: dict | None = None,
                   model_options: dict | None = None) -> DataFrame:
    """Profile, segments, models, retention economics and churn by dimension."""
    spark = subjects.sparkSession
    shared_dir(spark)
    subjects = subjects.checkpoint()  # every section reads it, the models several times
    profile = quality.profile_subjects(subjects, blank_text, outcome)
    segments = churn.segments(subjects, tenure, services, charge, churned,
                              **(segment_options or {}))
    scores, metrics, top = churn.model_comparison(subjects, key, churned, categorical, numeric,
                                                  keep=[at_stake], **(model_options or {}))
    chosen = scores.join(models.best_model(metrics), "model", "left_semi")
    policies = decision.retention_policies(chosen, churned, "prob", at_stake)
    def pick(rank, column):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))
    economics = policies.agg(
        F.lit(decision.OFFER_COST).alias("retention_offer_cost"),
        chosen.agg(F.count(F.lit(1))).scalar().alias("test_set_size"),
        pick(1, "total_cost").alias("no_model_cost"),
        pick(2, "total_cost").alias("default_threshold_cost"),
        F.bround(pick(3, "threshold"), 3).alias("optimal_threshold"),
        pick(3, "total_cost").alias("optimal_cost"),
        pick(3, "savings_vs_none").alias("savings_vs_no_model"),
        pick(3, "savings_vs_default").alias("savings_vs_default"))
    curve = decision.with_value_cost(decision.threshold_counts(
        chosen, churned, "prob", decision.RETENTION_GRID, value=at_stake)).select(
        "threshold", F.col("total_cost").alias("cost"))
    by_contract = churn.churn_by(subjects, F.col(contract), "contract_type", churned)
    by_tenure = churn.churn_by_tenure(subjects, tenure, churned)
    return report_document(spark, "churn", {
        "data_quality": _printed(profile),
        "segments": records(segments, ["segment"]),
        "model_comparison": records(_printed(metrics), ["model"]),
        "feature_importance": records(top, [-F.col("importance"), "feature"]),
        "cost_optimization": economics,
        "threshold_curve": records(_printed(curve), ["threshold"]),
        "churn_by_contract": records(_printed(by_contract), ["contract_type"]),
        "churn_by_tenure": records(_printed(by_tenure), [
            fx.bin_ordinal("tenure_bucket", fx.TENURE_LABELS)])})

"""Every report and operator run over the driver tables.

Each function takes a session and a table folder and returns a DataFrame. Limits that the
reports take as parameters are those fitting the driver tables; the library keeps its own
defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge import bindings as b
from fieldgauge.functions import columns as fx
from fieldgauge.operators import clusters, decision, experiment as x, features as ft, metrics, \
    models, ordered, quality, sketches, trees
from fieldgauge.plans import churn, documents, experiment as xp, forecast, marketplace as m
from fieldgauge.session import prepare, scratch_path
from fieldgauge.sources import checked, readers, writers
from fieldgauge.streaming import ledger, monitor, scoring

# Limits fitting the driver tables.
CAP = 50
MIN_MONTH, MIN_CATEGORY, MIN_STATE = 60, 2400, 150
UNDEFINED_PAYMENT = "4-NOT SPECIFIED"
SENSORS = ("s_1", "s_2", "s_3")
SUBJECT_NUMBERS = ("tenure", "num_services", "monthly")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Money as double, whole numbers as long, dates as text: types any engine compares."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(function(prepare(spark), sf_dir))
    run.__doc__ = function.__doc__
    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


_MADE: dict[tuple[str, str, str], str] = {}


def made_once(spark: SparkSession, d: str, name: str, build: Callable[[str], None]) -> str:
    """The path that ``build`` wrote to, once per application and table folder: models are
    trained by the first entry that needs them and loaded by the others."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        path = scratch_path(spark, name)
        build(path)
        _MADE[key] = path
    return _MADE[key]


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Figures that rest on sums of doubles, cut where the order of summing cannot show."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- marketplace ---------------------------------------------------------

MARKET = {"delivered": b.DELIVERED, "minor_units": b.CENTS}


@query
def kpis(spark, d):
    return m.kpis(b.orders_only(spark, d), b.items(spark, d), b.reviews(spark, d),
                  **MARKET)


@query
def kpis_dedup(spark, d):
    return m.kpis(b.orders_only(spark, d), b.items(spark, d), b.reviews(spark, d), "dedup",
                  **MARKET)


@query
def monthly_revenue(spark, d):
    return m.monthly_revenue(b.orders_only(spark, d), b.items(spark, d), **MARKET)


@query
def delivery_vs_reviews(spark, d):
    return m.delivery_vs_reviews(b.orders(spark, d), b.reviews(spark, d), delivered=b.DELIVERED)


@query
def late_rate_trend(spark, d):
    return m.late_rate_trend(b.orders(spark, d), delivered=b.DELIVERED)


def _category_risk(spark, d, mode):
    return m.category_risk(b.orders(spark, d), b.items(spark, d), b.products(spark, d),
                           b.translations(spark), b.reviews(spark, d), mode=mode,
                           min_orders=MIN_CATEGORY, **MARKET)


@query
def category_risk(spark, d):
    return _category_risk(spark, d, "as_joined")


@query
def category_risk_dedup(spark, d):
    return _category_risk(spark, d, "dedup")


def _state_performance(spark, d, mode):
    return m.state_performance(b.orders(spark, d), b.items(spark, d), b.customers(spark, d),
                               b.reviews(spark, d), mode=mode, min_orders=MIN_STATE,
                               **MARKET)


@query
def state_performance(spark, d):
    return _state_performance(spark, d, "as_joined")


@query
def state_performance_dedup(spark, d):
    return _state_performance(spark, d, "dedup")


@query
def top_states(spark, d):
    """The three states with the most revenue."""
    return m.state_performance(b.orders(spark, d), b.items(spark, d), b.customers(spark, d),
                               b.reviews(spark, d), min_orders=0, top=3, **MARKET)


@query
def payment_breakdown(spark, d):
    return m.payment_breakdown(b.payments(spark, d), UNDEFINED_PAYMENT, minor_units=b.CENTS)


@query
def revenue_late_trend(spark, d):
    return m.revenue_late_trend(b.orders(spark, d), b.items(spark, d), MIN_MONTH,
                                **MARKET)


@query
def late_effect(spark, d):
    return m.late_effect(b.orders(spark, d), b.reviews(spark, d), delivered=b.DELIVERED)


@query
def customers_by_period(spark, d):
    """Distinct customers per month, year, priority and in all, from stored sketches of (month,
    priority): exact counts, and whether the estimate lies within four standard errors."""
    keys = {"month": ["month", "priority"], "year": ["year", "priority"], "priority": ["priority"],
            "all": []}
    placed = b.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    path = scratch_path(spark, "customer-sketches")
    sketches.store(sketches.distinct_sketches(placed, "customer", ["month", "priority"]), path,
                   "month")
    stored = sketches.load(spark, path, "month").withColumn("year", F.substring("month", 1, 4))

    def labelled(df, level, by, *measures):
        period = F.col(level) if level in ("month", "year") else F.lit(None).cast("string")
        priority = F.col("priority") if "priority" in by else F.lit(None).cast("string")
        return df.select(F.lit(level).alias("level"), period.alias("period"),
                         priority.alias("priority"), *measures)
    parts = []
    for level, by in keys.items():
        exact = labelled(placed.groupBy(*by).agg(F.count_distinct("customer").alias("customers")),
                         level, by, "customers")
        guess = labelled(sketches.estimated(sketches.merged(stored, by), "guess"), level, by,
                         F.col("rows").alias("orders"), "guess")
        same = [exact[c].eqNullSafe(guess[c]) for c in ("level", "period", "priority")]
        bound = 4 * sketches.standard_error() * F.col("customers") + 1
        parts.append(exact.join(guess, same, "full").select(
            exact["level"], exact["period"], exact["priority"], "orders", "customers",
            (F.abs(F.col("guess") - F.col("customers")) <= bound).alias("within")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- experiment ----------------------------------------------------------

DESIGN = x.Design(order=("ts", "event_id"))
BY = ["experiment"]


def _arms(spark, d):
    return x.arm_counts(b.experiment(spark, d), BY, DESIGN)


@query
def experiment_profile(spark, d):
    return x.quality_profile(_arms(spark, d)).select(
        *BY, "raw_rows", "mismatched_rows", "duplicate_rows", "clean_rows", "rows_removed",
        "mismatched_pct", "retained_pct")


@query
def experiment_arms_clean(spark, d):
    return _arms(spark, d).select(*BY, "n_control", "n_treatment", "conversions_control",
                                  "conversions_treatment")


@query
def experiment_clean_rows(spark, d):
    clean = quality.clean_experiment(
        b.experiment(spark, d), [], DESIGN.user, DESIGN.order, DESIGN.arm, DESIGN.exposure,
        DESIGN.pairs)
    return clean.select("user_id", "event_id", "experiment", "arm", "converted")


@query
def duplicate_users(spark, d):
    return quality.duplicate_rows(b.experiment(spark, d), ["user_id"], ["arm"])


@query
def experiment_srm(spark, d):
    return rounded(x.srm_check(_arms(spark, d)), 8, "srm_chi2", "srm_p_value").select(
        *BY, "expected_per_arm", "srm_chi2", "srm_p_value", "srm_passed")


@query
def experiment_ztest(spark, d):
    figures = ("control_rate", "treatment_rate", "absolute_diff", "relative_diff_pct",
               "z_statistic", "ci_low", "ci_high", "p_value")
    return rounded(x.two_proportion_test(_arms(spark, d)), 8, *figures).select(
        *BY, *figures, "significant")


@query
def experiment_power(spark, d):
    return rounded(x.achieved_power(_arms(spark, d)), 8, "effect_size", "achieved_power").select(
        *BY, "effect_size", "achieved_power")


@query
def experiment_mde(spark, d):
    return x.detectable_lift(_arms(spark, d), grid=(0.001, 0.2, 200)).select(
        *BY, "n_control", "minimum_detectable_lift")


@query
def experiment_verdict(spark, d):
    return xp.verdict(b.experiment(spark, d), BY, DESIGN).select(
        *BY, "raw_rows", "rows_removed", "srm_chi2", "srm_passed", "absolute_diff",
        "z_statistic", "p_value", "significant", "achieved_power")


@query
def experiment_daily(spark, d):
    return x.daily_rates(b.experiment(spark, d), [], DESIGN)


@query
def experiment_daily_pivot(spark, d):
    return x.daily_pivot(b.experiment(spark, d), BY, DESIGN)


# --- equipment series ----------------------------------------------------

@query
def rul_labels(spark, d):
    return ft.rul_labels(b.engine_series(spark, d), "unit", "cycle", cap=CAP).select(
        "unit", "cycle", "RUL")


@query
def rolling_features(spark, d):
    return ft.rolling_features(b.engine_series(spark, d), SENSORS, unit="unit", cycle="cycle")


@query
def last_observation(spark, d):
    return ordered.last_row(b.engine_series(spark, d), ["unit"], ["cycle"])


@query
def last_n_buffer(spark, d):
    return ordered.last_n_rows(b.readings(spark, d), ["device"], ["ts", "event_id"]).select(
        "device", "event_id", "health", "torque", "temperature")


@query
def sensor_unpivot(spark, d):
    return ft.melt(b.engine_series(spark, d), ["unit", "cycle"], ["s_1", "s_2"])


def _regression_pairs(spark, d):
    """True remaining life and a prediction made of the trailing mean."""
    featured = ft.rolling_features(b.engine_series(spark, d), ["s_1"], unit="unit",
                                   cycle="cycle")
    return ft.rul_labels(featured, "unit", "cycle", cap=CAP).select(
        "unit", "cycle", F.col("RUL").cast("double").alias("RUL"),
        (F.col("s_1_roll_mean") / 4 + 5).alias("predicted_RUL"))


METRICS = ("rmse", "mae", "r2", "late_penalty_score")


@query
def regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(_regression_pairs(spark, d), "RUL",
                                              "predicted_RUL"), 6, *METRICS)


@query
def regression_metrics_by_split(spark, d):
    pairs = _regression_pairs(spark, d).withColumn(
        "split", F.when(F.col("unit") % 4 == 0, "held_out").otherwise("in_sample"))
    return rounded(metrics.regression_metrics(pairs, "RUL", "predicted_RUL", ["split"]), 6,
                   *METRICS)


@query
def late_penalty_score(spark, d):
    pairs = _regression_pairs(spark, d)
    return rounded(pairs.groupBy("unit").agg(
        F.sum(metrics.late_penalty("RUL", "predicted_RUL")).alias("score")), 6, "score")


@query
def failure_scores(spark, d):
    pairs = ordered.last_row(_regression_pairs(spark, d), ["unit"], ["cycle"])
    return rounded(forecast.score_table(pairs, unit="unit", cap=CAP), 9, "predicted_RUL",
                   "failure_probability")


# --- decisions -----------------------------------------------------------

@query
def threshold_sweep_flat(spark, d):
    counts = decision.threshold_counts(b.scored(spark, d), "label", "prob",
                                       decision.MAINTENANCE_GRID)
    return decision.with_reactive_savings(decision.with_flat_cost(counts))


@query
def threshold_sweep_by_fleet(spark, d):
    counts = decision.threshold_counts(b.scored(spark, d), "label", "prob",
                                       decision.MAINTENANCE_GRID_99, by=["fleet"])
    return decision.with_flat_cost(counts)


@query
def threshold_sweep_value(spark, d):
    counts = decision.threshold_counts(b.scored(spark, d), "label", "prob",
                                       decision.RETENTION_GRID, value="at_stake")
    return decision.with_value_cost(counts)


@query
def optimal_threshold(spark, d):
    counts = decision.threshold_counts(b.scored(spark, d), "label", "prob",
                                       decision.MAINTENANCE_GRID, by=["fleet"])
    return decision.optimal_threshold(decision.with_flat_cost(counts), ["fleet"])


@query
def policy_comparison(spark, d):
    return decision.maintenance_policies(b.scored(spark, d), "label", "prob").withColumn(
        "threshold", F.coalesce("threshold", F.lit(-1.0)))


@query
def retention_policies(spark, d):
    return decision.retention_policies(b.scored(spark, d), "label", "prob", "at_stake",
                                       by=["fleet"]).withColumn(
        "threshold", F.coalesce("threshold", F.lit(-1.0)))


@query
def classification_metrics(spark, d):
    return metrics.classification_metrics(b.classified(spark, d), "label", "prob")


@query
def roc_auc(spark, d):
    return metrics.roc_auc(b.classified(spark, d), "label", "prob")


@query
def roc_auc_by_fleet(spark, d):
    return metrics.roc_auc(b.scored(spark, d), "label", "prob", ["fleet"])


@query
def calibration(spark, d):
    scored = b.scored(spark, d).withColumn("prob", F.col("prob").cast("decimal(18,6)"))
    band = F.floor(F.col("prob") * 10).cast("long")
    return rounded(metrics.calibration(scored, band, "label", "prob"), 9, "mean_probability")


# --- subjects ------------------------------------------------------------

@query
def subject_profile(spark, d):
    return quality.profile_subjects(b.subjects(spark, d), "total_text", "churn")


@query
def blank_to_zero(spark, d):
    return b.subjects(spark, d).select(
        "customer", fx.is_blank("total_text").alias("was_blank"),
        fx.blank_to_zero("total_text").alias("total_charges"))


@query
def service_count(spark, d):
    return b.subjects(spark, d).select("customer", "num_services")


def _labelled_subjects(spark, d):
    return b.subjects(spark, d).withColumn("churned", fx.yes_flag("churn"))


@query
def churn_by_contract(spark, d):
    return churn.churn_by(_labelled_subjects(spark, d), F.col("contract"), "contract_type",
                          "churned")


@query
def churn_by_bucket(spark, d):
    return churn.churn_by_tenure(_labelled_subjects(spark, d), "tenure", "churned")


@query
def segment_by_rule(spark, d):
    """Segment profile, name and risk tier over a fixed grouping instead of a clustering."""
    grouped = _labelled_subjects(spark, d).withColumn(
        "segment", (F.col("tenure") > 40).cast("int") * 2 + (F.col("num_services") > 4).cast("int"))
    return models.segment_profile(grouped, "segment", "tenure", "num_services", "monthly",
                                  "churned").select("segment", "customers", "label", "risk")


@query
def stratified_split(spark, d):
    return models.stratified_split(_labelled_subjects(spark, d), "customer", "churned").select(
        "customer", "churned", "is_test")


@query
def stratified_split_exact(spark, d):
    return models.stratified_split(_labelled_subjects(spark, d), "customer", "churned",
                                   exact=True).select("customer", "churned", "is_test")


@query
def standardised_features(spark, d):
    scaled = models.standardise(b.subjects(spark, d), SUBJECT_NUMBERS)
    names = [f"{c}_std" for c in SUBJECT_NUMBERS]
    return rounded(scaled, 6, *names).select("customer", *names)


@query
def label_codes(spark, d):
    coded = models.encode_labels(b.subjects(spark, d), ["contract", "svc_low"])
    return coded.select("customer", "contract", "contract_code", "svc_low_code")


@query
def unit_split(spark, d):
    train, held_out = models.split_by_unit(b.engine_rows(spark, d), "unit")
    sides = (train.select("unit", F.lit("train").alias("side"))
             .unionByName(held_out.select("unit", F.lit("held_out").alias("side"))))
    return sides.groupBy("unit", "side").agg(F.count(F.lit(1)).alias("n"))


@query
def segments_kmeans(spark, d):
    return churn.segments(_labelled_subjects(spark, d), "tenure", "num_services", "monthly",
                          "churned")


@query
def segment_certificate(spark, d):
    """Customers clustered, and those that stand nearer to the mean of another cluster.

    The means are taken anew from the assigned customers, not from the model.
    """
    numbers = ("tenure", "num_services", "monthly")
    clustered = models.segment_customers(b.subjects(spark, d), numbers)
    scaled = models.standardise(clustered, numbers).persist()
    names = [f"{c}_std" for c in numbers]
    means = scaled.groupBy("segment").agg(*[F.avg(n).alias(n) for n in names]).collect()

    def distance(mean):
        return sum((F.col(n) - F.lit(mean[n])) * (F.col(n) - F.lit(mean[n])) for n in names)
    own = F.coalesce(*[F.when(F.col("segment") == m["segment"], distance(m)) for m in means])
    nearest = F.least(*[distance(m) for m in means])
    return scaled.agg(F.count(F.lit(1)).alias("customers"),
                      F.count_if(own > nearest + 1e-6).alias("misplaced"))


@query
def kmeans_restarts(spark, d):
    """Customers clustered from all starts in shared scans: how far the reported cost is from the
    one summed over the assigned customers, and starts that end below the chosen one."""
    numbers = ("tenure", "num_services", "monthly")
    names = [f"{c}_std" for c in numbers]
    scaled = models.standardise(b.subjects(spark, d), numbers).select("customer", *names).persist()
    best = clusters.kmeans_restarts(scaled, names, key=F.col("customer"), k=models.CLUSTERS,
                                    restarts=models.RESTARTS, seed=models.SEED)
    placed = clusters.assigned(scaled, names, best, "segment")
    own = F.lit(0.0)
    for i, n in enumerate(names):
        centre = F.get(F.array(*[F.lit(c[i]) for c in best.centres]), F.col("segment"))
        own = own + (F.col(n) - centre) * (F.col(n) - centre)
    return placed.agg(
        F.count("segment").alias("customers"), F.count_distinct("segment").alias("segments"),
        F.lit(len(best.costs)).cast("long").alias("starts"),
        F.lit(sum(c < best.cost for c in best.costs)).cast("long").alias("lower_starts"),
        F.round(F.abs(F.sum(own) / best.cost - 1), 6).alias("cost_gap"))


def _model_subjects(spark, d):
    return (_labelled_subjects(spark, d)
            .withColumn("total_charges", fx.blank_to_zero("total_text"))
            .withColumn("at_stake", (F.col("monthly") * decision.MONTHS_AT_STAKE)
                        .cast("decimal(20,2)")))


def _comparison(spark, d):
    """Held-out scores, metrics per model and top features of both classifiers."""
    def build(path):
        scores, _, top = churn.model_comparison(
            _model_subjects(spark, d), "customer", "churned", ["contract", *b.SERVICES],
            [*SUBJECT_NUMBERS, "total_charges"], keep=["at_stake"])
        scores.write.parquet(f"{path}/scores")
        top.write.parquet(f"{path}/top")

    path = made_once(spark, d, "classifiers", build)
    scores = spark.read.parquet(f"{path}/scores")
    return (scores, models.model_metrics(scores, "churned"),
            models.top_features(spark.read.parquet(f"{path}/top")))


@query
def model_split_counts(spark, d):
    """Held-out customers scored by each model, by outcome."""
    return _comparison(spark, d)[0].groupBy("model", "churned").agg(
        F.count(F.lit(1)).alias("held_out"), F.count_distinct("customer").alias("customers"))


@query
def model_auc_agreement(spark, d):
    """Rows ranked per model, and how far the rank-sum AUC is from MLlib's curve."""
    scores = _comparison(spark, d)[0]
    ranked = metrics.roc_auc(scores, "churned", "prob", ["model"])
    curve = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="churned", numBins=0)
    areas = [(name, curve.evaluate(scores.where(F.col("model") == name)))
             for name in (models.LOGISTIC, models.FOREST)]
    other = spark.createDataFrame(areas, "model string, area double")
    return ranked.join(other, "model").select(
        "model", (F.col("positives") + F.col("negatives")).alias("ranked"),
        F.round(F.abs(F.col("auc") - F.col("area")), 6).alias("difference"))


@query
def model_comparison(spark, d):
    return _comparison(spark, d)[1]


@query
def feature_importance(spark, d):
    return _comparison(spark, d)[2]


@query
def retention_economics(spark, d):
    scores, model_metrics, _ = _comparison(spark, d)
    return churn.retention(scores, model_metrics, "churned", "at_stake")


# --- forecast ------------------------------------------------------------

def _series(spark, d):
    """Units' cycles, numbered once and stored."""
    path = made_once(spark, d, "series", lambda p: b.engine_series(spark, d).write.parquet(p))
    return spark.read.parquet(path)


def _trained(spark, d):
    """The folder of a stored model and its training rows."""
    def train_and_save(path):
        forecast.training_table(_series(spark, d), SENSORS, unit="unit", cycle="cycle",
                                cap=CAP).write.parquet(f"{path}/rows")
        fitted, _ = forecast.train_baseline(spark.read.parquet(f"{path}/rows"), SENSORS,
                                            unit="unit")
        regressor = fitted.stages[-1]
        models.save_model(fitted, path, "1", ft.feature_columns(SENSORS), {
            "trees": regressor.getMaxIter(), "depth": regressor.getMaxDepth(),
            "rate": regressor.getStepSize()})

    return made_once(spark, d, "forecast", train_and_save)


def _model(spark, d):
    return models.load_model(spark, _trained(spark, d))[0]


def _forecast(spark, d):
    """A stored model, its training rows and the held-out units cut off at 60% of their life."""
    model, table = _model(spark, d), spark.read.parquet(f"{_trained(spark, d)}/rows")
    _, validation = models.split_by_unit(table, "unit")
    _, held_out = models.split_by_unit(_series(spark, d), "unit")
    lives = ordered.with_group_max(held_out, ["unit"], "cycle", "life")
    observed = lives.filter(F.col("cycle") <= F.ceil(F.col("life") * 0.6))
    truth = ordered.last_row(observed, ["unit"], ["cycle"]).select(
        "unit", (F.col("life") - F.col("cycle")).alias("RUL"))
    return model, table, validation, observed.drop("life"), truth


def _held_out_scores(model, observed, truth):
    last = forecast.last_cycles(observed, SENSORS, unit="unit", cycle="cycle")
    predicted = models.predict(model, forecast.with_truth(last, truth, unit="unit", cap=CAP))
    return predicted


@query
def rul_evaluation(spark, d):
    model, table, _, observed, truth = _forecast(spark, d)
    train, _ = models.split_by_unit(table, "unit")
    return forecast.evaluate(models.predict(model, train),
                             _held_out_scores(model, observed, truth))


@query
def rul_scores(spark, d):
    model, _, _, observed, truth = _forecast(spark, d)
    return forecast.score_table(_held_out_scores(model, observed, truth), unit="unit", cap=CAP)


@query
def rul_trajectory(spark, d):
    table = spark.read.parquet(f"{_trained(spark, d)}/rows")
    return models.predict(_model(spark, d), table).select("unit", "cycle", "RUL", "predicted_RUL")


@query
def rul_split_counts(spark, d):
    table = models.split_counts(b.readings(spark, d), _model(spark, d).stages[-1],
                                ft.feature_columns(SENSORS))
    return models.top_features(table)


@query
def rul_score_batch(spark, d):
    return forecast.service_response(_model(spark, d), _series(spark, d), SENSORS, unit="unit",
                                     cycle="cycle", version="1")


@query
def rul_score_stream(spark, d):
    model, series = _model(spark, d), _series(spark, d)
    folder = _MADE[spark.sparkContext.applicationId, d, "series"]
    stream = monitor.table_stream(spark, folder, "*.parquet", series.schema)
    job = scoring.ScoringJob(model, "1", scratch_path(spark, "scoring"), "unit", "cycle", SENSORS)
    job.run(stream)
    return job.latest_answers(spark)


@query
def forecast_model(spark, d):
    """The stored model's card and size."""
    model, card = models.load_model(spark, _trained(spark, d))
    regressor = model.stages[-1]
    row = (card["version"], len(card["features"]), card["settings"]["depth"],
           card["settings"]["rate"], regressor.getNumTrees,
           round(float(sum(regressor.featureImportances.toArray())), 6))
    return spark.createDataFrame([row], "version string, features long, depth long, "
                                 "rate double, trees long, importance_total double")


@query
def forecast_nodes(spark, d):
    """The stored model read as a table of nodes: rows at the roots, splits whose children miss
    rows, nodes out of reach, and how far importances from nodes are from the model's own."""
    model, path = _model(spark, d), _trained(spark, d)
    features = ft.feature_columns(SENSORS)
    nodes = trees.with_weighted_rows(trees.node_table(spark, f"{path}/model/stages/*"),
                                     classes=False)
    own = spark.createDataFrame(
        list(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True)),
        "feature string, own double")
    gap = trees.importances(nodes, features, per_tree=False).join(own, "feature").agg(
        F.round(F.max(F.abs(F.col("importance") - F.col("own"))), 6)).scalar()
    depth = model.stages[-1].getMaxDepth()
    return trees.tree_shapes(nodes).agg(
        F.count(F.lit(1)).alias("trees"), F.min("root_rows").alias("least_root"),
        F.max("root_rows").alias("largest_root"), F.sum("broken").alias("broken"),
        F.sum(F.col("nodes") - F.col("reached")).alias("unreached"),
        F.count_if(F.col("depth") > depth).alias("too_deep"), gap.alias("importance_gap"))


def _validated(spark, d):
    """A model stopped by its validation units, with its card, and the rows with their side."""
    def train_and_save(path):
        table = forecast.training_table(_series(spark, d), SENSORS, unit="unit",
                                        cycle="cycle", cap=CAP)
        table.write.parquet(f"{path}/rows")
        fitted, _ = forecast.train_validated(spark.read.parquet(f"{path}/rows"), SENSORS,
                                             unit="unit")
        booster = fitted.stages[-1]
        models.save_model(fitted, path, "1", ft.feature_columns(SENSORS), {
            "trees": booster.getNumTrees, "allowed": booster.getMaxIter(),
            "depth": booster.getMaxDepth(), "rate": booster.getStepSize()})

    path = made_once(spark, d, "validated", train_and_save)
    rows = spark.read.parquet(f"{path}/rows").withColumn("side", forecast.unit_sides("unit"))
    return (*models.load_model(spark, path), rows)


@query
def forecast_validation(spark, d):
    """Units and rows per side of the validated model, units on two sides, trees in the card past
    the one of least validation error, and that error against one summed from the answers."""
    model, card, rows = _validated(spark, d)
    validation = rows.filter("side = 'validation'")
    curve = models.error_curve(model, validation).persist()
    least = curve.agg(F.min_by("trees", F.struct("mse", "trees"))).scalar()
    last = curve.agg(F.max_by("mse", "trees")).scalar()
    error = models.predict(model, validation.dropna(subset=card["features"])).agg(
        F.avg((F.col("predicted_RUL") - F.col("RUL")) * (F.col("predicted_RUL") - F.col("RUL")))
    ).scalar()
    units = rows.groupBy("unit").agg(F.count_distinct("side").alias("sides"))
    shared = units.agg(F.count_if(F.col("sides") > 1)).scalar()
    return rows.groupBy("side").agg(
        F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("cycles"),
        shared.alias("shared_units"),
        (F.lit(card["settings"]["trees"]).cast("long") - least).alias("trees_past_best"),
        F.round(F.abs(error / last - 1), 6).alias("error_gap"))


@query
def forecast_answers(spark, d):
    """Answers of the stored model on every cycle, and on every unit by batch and stream."""
    cycles = rul_trajectory(spark, d).agg(
        F.count("predicted_RUL").alias("cycles")).withColumn("k", F.lit(1))
    batch = rul_score_batch(spark, d).select("unit", F.col("predicted_RUL").alias("one"))
    stream = rul_score_stream(spark, d).select(F.col("unit").alias("of"),
                                               F.col("predicted_RUL").alias("two"))
    units = batch.join(stream, batch["unit"].eqNullSafe(stream["of"]), "full").agg(
        F.count("one").alias("batch_units"), F.count("two").alias("stream_units"),
        F.count_if(~F.col("one").eqNullSafe(F.col("two"))).alias("different"))
    return cycles.join(units.withColumn("k", F.lit(1)), "k").drop("k")


@query
def rolling_features_gaps(spark, d):
    """Trailing means of a series with NaN and NULL readings, which are left out."""
    gaps = b.engine_rows(spark, d).withColumn(
        "s_1", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 13 != 0, F.col("s_1")))
    series = ordered.row_position(gaps, ["unit"], ["ts", "event_id"], out="cycle")
    return rounded(ft.rolling_features(series, ["s_1"], unit="unit", cycle="cycle"), 6,
                   "s_1_roll_mean").select("unit", "cycle", "s_1_roll_mean")


@query
def roc_auc_gaps(spark, d):
    """AUC over scores with NaN, which rank lowest, and NULL, which are left out."""
    gaps = b.classified(spark, d).withColumn(
        "prob", F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan")))
        .when(F.col("doc_id") % 11 != 0, F.col("prob")))
    return metrics.roc_auc(gaps, "label", "prob")


@query
def request_errors(spark, d):
    """Scoring requests, some of them without a reading or a valid cycle, by what is wrong."""
    requests = b.engine_rows(spark, d).select(
        "unit", (F.col("event_id") % 40).alias("cycle"),
        F.when(F.col("event_id") % 50 != 0, F.col("s_1")).alias("s_1"), "s_2", "s_3")
    checked = requests.withColumn("error", scoring.request_error("unit", "cycle", SENSORS))
    return checked.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(
        F.count(F.lit(1)).alias("requests"))


def _requests(spark, d):
    """Requests of which some lack the unit, the reading or a valid cycle, or repeat a cycle."""
    return b.engine_rows(spark, d).select(
        F.col("event_id").alias("request"),
        F.when(F.col("event_id") % 17 != 0, F.col("unit")).alias("unit"),
        (F.col("event_id") % 40).alias("cycle"),
        F.when(F.col("event_id") % 50 != 0, F.col("s_1")).alias("s_1"), "s_2", "s_3")


def _outcomes(answers, rejects):
    return (answers.select("request", F.lit("answered").alias("outcome"))
            .unionByName(rejects.select("request", F.col("error").alias("outcome")))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"),
                                    F.count_distinct("request").alias("different")))


@query
def request_outcomes(spark, d):
    """What becomes of every request of a stream."""
    model = _model(spark, d)
    folder = scratch_path(spark, "requests")
    _requests(spark, d).write.parquet(folder)
    job = scoring.ScoringJob(model, "1", scratch_path(spark, "scoring"), "unit", "cycle", SENSORS,
                             request="request")
    job.run(monitor.table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema))
    return _outcomes(job.answers(spark), job.rejects(spark))


@query
def request_outcomes_batch(spark, d):
    """The same of a table of requests."""
    return _outcomes(*scoring.score_requests(
        _model(spark, d), _requests(spark, d), SENSORS, unit="unit", cycle="cycle", version="1",
        request="request"))


@query
def maintenance_roi(spark, d):
    model, _, _, observed, truth = _forecast(spark, d)
    path = scratch_path(spark, "scores")
    scores = forecast.score_table(_held_out_scores(model, observed, truth), unit="unit", cap=CAP)
    writers.write_scores(scores, path, ["unit", *forecast.SCORE_COLUMNS])
    return decision.maintenance_policies(spark.read.parquet(path), "actual_failure_soon",
                                         "failure_probability")


# --- monitor -------------------------------------------------------------

def _event_stream(spark, d):
    schema = b.table(spark, d, "events").schema
    return monitor.table_stream(spark, d, "events.parquet", schema)


def _reading_stream(spark, d):
    return monitor.with_event_time(b.device_readings(_event_stream(spark, d))).drop("received_at")


@query
def equipment_status(spark, d):
    return monitor.with_status(b.readings(spark, d)).groupBy("device", "status").agg(
        F.count(F.lit(1)).alias("readings"))


@query
def status_alerts(spark, d):
    path = scratch_path(spark, "alerts")
    monitor.run_append(monitor.alerts(_reading_stream(spark, d)), path,
                       scratch_path(spark, "alerts-checkpoint"))
    return spark.read.parquet(path).select("event_id", "device", "status", "message")


def _trend(spark, d, **window):
    path = scratch_path(spark, "trend")
    stream = monitor.with_event_time(_event_stream(spark, d)).withColumn(
        "value", F.col("value").cast(b.MONEY))
    monitor.run_update(monitor.trend_stream(stream, "value", ["event_type"], **window), path,
                       scratch_path(spark, "trend-checkpoint"), ["window_start", "event_type"])
    return monitor.read_latest(spark, path)


@query
def tumbling_trend(spark, d):
    return _trend(spark, d, length="1 day")


@query
def sliding_trend(spark, d):
    return _trend(spark, d, length="1 day", slide="6 hours")


def _updates(spark, stream, keys):
    path = scratch_path(spark, "updates")
    monitor.run_update(stream, path, scratch_path(spark, "updates-checkpoint"), keys)
    return monitor.read_latest(spark, path)


@query
def latest_reading(spark, d):
    newest = monitor.latest_reading(_reading_stream(spark, d), "device", ["ts", "event_id"])
    return _updates(spark, newest, ["device"]).select("device", "event_id", "health", "torque",
                                                      "temperature")


@query
def step_counter(spark, d):
    return _updates(spark, monitor.step_counter(_reading_stream(spark, d), "device"), ["device"])


@query
def stream_buffer(spark, d):
    buffered = monitor.buffer_stream(_reading_stream(spark, d), "device", ["ts", "event_id"])
    return _updates(spark, buffered, ["device"]).select("device", "event_id", "health", "torque",
                                                        "temperature")


@query
def equipment_board(spark, d):
    folder, sensors = scratch_path(spark, "monitor"), ["temperature", "torque"]
    readings = monitor.with_event_time(b.device_readings(_event_stream(spark, d)))
    for running in monitor.start_monitor(readings, folder, key="device",
                                         order=["ts", "event_id"], sensors=sensors):
        running.awaitTermination()
    return monitor.board(spark, folder, "device", sensors).select(
        "device", "event_id", "status", "steps", "tool_wear", "failures", "warnings",
        (F.col("received_at") > F.col("ts")).alias("received"),
        F.round("trend_temperature", 6).alias("trend_temperature"), "trend_torque")


@query
def late_ledger(spark, d):
    """Four batches of events: what each type's windows count, and what came too late."""
    job = ledger.TrendLedger(scratch_path(spark, "ledger"), "value", ["event_type"],
                             delay="10 days")
    events = b.table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.col("value").cast(b.MONEY).alias("value"))
    for number in range(4):
        job.process(events.where(F.col("event_id") % 4 == number), number)
    counted = job.trend(spark).groupBy("event_type").agg(
        F.sum("rows").alias("counted"), F.count(F.lit(1)).alias("windows"),
        F.max("n").alias("most"))
    late = job.late(spark).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("late"), F.sum("value").alias("late_value"))
    return counted.join(late, "event_type", "full")


@query
def buffer_append(spark, d):
    """A day's readings added to the buffer of all earlier days."""
    readings = b.readings(spark, d)
    last_day = F.to_date("ts") >= F.lit("2024-01-30")
    buffer = ordered.last_n_rows(readings.filter(~last_day), ["device"], ["ts", "event_id"])
    return monitor.append_readings(buffer, readings.filter(last_day), "device",
                                   ["ts", "event_id"]).select("device", "event_id")


@query
def stream_dedup(spark, d):
    path = scratch_path(spark, "dedup")
    user = (F.col("event_id") - F.when((F.col("event_id") % 97 == 0) & (F.col("event_id") > 0), 1)
            .otherwise(0)).alias("user_id")
    visits = monitor.with_event_time(_event_stream(spark, d)).select(user, "ts")
    monitor.run_append(monitor.distinct_readings(visits, ["user_id"]), path,
                       scratch_path(spark, "dedup-checkpoint"))
    return spark.read.parquet(path).select("user_id")


# --- sources, sinks and report text --------------------------------------

@query
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"]
    writers.write_scores(b.table(spark, d, "part").withColumn(
        "p_retailprice", F.col("p_retailprice").cast(b.MONEY)), path, columns, fmt="csv")
    part = readers.load_csv(spark, path, "p_partkey long, p_name string, p_brand string, "
                            "p_type string, p_retailprice decimal(18,2)", required=["p_type"])
    return part.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("parts"), F.count_distinct("p_brand").alias("brands"),
        F.sum("p_retailprice").alias("total_price"))


@query
def whitespace_scan(spark, d):
    path = scratch_path(spark, "text")
    b.engine_rows(spark, d).select(F.format_string(
        " %d   %d %s  %s  ", "unit", "event_id", F.col("s_1").cast(b.MONEY).cast("string"),
        F.col("s_2").cast("string"))).write.text(path)
    rows = readers.load_whitespace(spark, path, {"unit": "long", "event_id": "long",
                                                 "s_1": b.MONEY, "s_2": b.MONEY})
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("s_1").alias("s_1"),
                                    F.max("s_2").alias("s_2"))


@query
def reviews_scan(spark, d):
    """Review files whose comments hold line breaks and quotes, read by many tasks."""
    path = scratch_path(spark, "reviews")
    docs = b.table(spark, d, "documents")
    created = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"),
                              F.lit("2024-01-01").cast("timestamp"))
    docs.select(
        F.concat(F.lit("r"), "doc_id").alias("review_id"), F.col("doc_id").alias("order_id"),
        (F.col("doc_id") % 5 + 1).alias("review_score"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('say "'), "source", F.lit('"\nto all')))
        .alias("review_comment_title"), F.col("text").alias("review_comment_message"),
        F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("review_creation_date"),
        F.when(F.col("doc_id") % 7 != 0, F.date_format(created, "yyyy-MM-dd HH:mm:ss"))
        .alias("review_answer_timestamp")
    ).write.options(header="true", escape='"').csv(path)
    rows, rejects = checked.load_csv_checked(spark, path, readers.MARKETPLACE_SCHEMAS["reviews"],
                                             staged=True)
    found = rows.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("review_comment_title").alias("titled"),
        F.sum(F.length("review_comment_title")).alias("title_chars"),
        F.sum(F.length("review_comment_message")).alias("message_chars"),
        F.count("review_answer_timestamp").alias("answered"),
        F.max("review_creation_date").alias("newest"))
    return found.unionByName(rejects.groupBy().agg(F.count(F.lit(1)).alias("reviews"))
                             .where("reviews > 0"), allowMissingColumns=True)


def _damaged_readings(spark, d):
    """Readings as lines of fields, some short, some with a bad number or time."""
    e = F.col("event_id")
    value = F.when(e % 11 == 0, "n/a").otherwise(F.col("value").cast(b.MONEY).cast("string"))
    ts = F.when(e % 13 == 0, F.lit("2024-02-30T25:00:00")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return b.table(spark, d, "events").select(
        e.cast("string").alias("event_id"), ts.alias("ts"),
        F.when(e % 17 != 0, value).alias("value"))


def _outcome_of_load(loaded):
    rows = loaded.rows.select(F.lit("loaded").alias("reason"), "event_id", "ts", "value")
    rejects = loaded.rejects.select(
        "reason", F.regexp_extract("record", r"^\s*(\d+)", 1).cast("long").alias("event_id"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast(b.MONEY).alias("value"))
    return rows.unionByName(rejects).groupBy("reason").agg(
        F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("ids"),
        F.max("ts").alias("newest"), F.sum("value").alias("total"))


@query
def csv_rejects(spark, d):
    """What becomes of every record of damaged CSV files: loaded, or rejected for a reason."""
    path = scratch_path(spark, "damaged-csv")
    readings = _damaged_readings(spark, d)
    # A record without its last field has one separator less.
    readings.select(F.concat_ws(",", "event_id", "ts", "value").alias("event_id,ts,value")) \
        .write.options(header="true", sep="\u0001").csv(path)
    return _outcome_of_load(checked.load_csv_checked(
        spark, path, f"event_id long, ts timestamp, value {b.MONEY}"))


@query
def whitespace_rejects(spark, d):
    """The same for lines of fields separated by blanks."""
    path = scratch_path(spark, "damaged-text")
    _damaged_readings(spark, d).select(F.concat(
        F.lit("  "), F.concat_ws("   ", "event_id", "ts", "value"))).write.text(path)
    return _outcome_of_load(checked.load_whitespace_checked(
        spark, path, {"event_id": "long", "ts": "timestamp", "value": b.MONEY}))


@query
def positional_truth(spark, d):
    """A file of one value per unit, keyed by its line, beside the units' last cycles."""
    path = scratch_path(spark, "truth")
    lives = b.engine_series(spark, d).groupBy("unit").agg(F.max("cycle").alias("life"))
    # The format is one file in unit order; it holds one line per unit.
    lives.repartition(1).sortWithinPartitions("unit").select(
        F.format_string("%d  ", "life")).write.text(path)
    truth = readers.load_positional(spark, path, "life", "line", "long")
    units = ordered.row_position(lives, [], ["unit"], out="line")
    return units.select("unit", "line").join(truth, "line").select("unit", "line", "life")


@query
def report_text(spark, d):
    money = F.col("o_totalprice").cast(b.MONEY)
    return b.table(spark, d, "orders").select(
        "o_orderkey", F.round(money, 1).alias("half_up"),
        F.bround(money.cast("decimal(18,1)"), 0).alias("half_even"),
        fx.month_key("o_orderdate").alias("month"), F.to_date("o_orderdate").alias("day"),
        fx.whole_text(F.floor(money)).alias("whole"),
        fx.display_label(F.translate("o_orderpriority", "- ", "__")).alias("label"))


@query
def marketplace_document(spark, d):
    """All marketplace reports as one JSON document."""
    tables = {"orders": b.orders(spark, d), "order_items": b.items(spark, d),
              "reviews": b.reviews(spark, d), "products": b.products(spark, d),
              "category_translation": b.translations(spark), "customers": b.customers(spark, d),
              "payments": b.payments(spark, d)}
    return documents.marketplace_document(
        spark, tables, min_category=MIN_CATEGORY, min_state=MIN_STATE,
        undefined_payment=UNDEFINED_PAYMENT, **MARKET)


@query
def marketplace_fields(spark, d):
    """Every figure of the marketplace document, read back from the written report."""
    path = scratch_path(spark, "report")
    writers.write_report(_QUERIES["marketplace_document"](spark, d), path)
    return readers.document_fields(readers.load_report(spark, path)).drop("report")


@query
def experiment_document(spark, d):
    """The verdict on all visits as one JSON document."""
    return documents.experiment_document(b.experiment(spark, d), DESIGN)


@query
def churn_document(spark, d):
    """The churn reports as one JSON document."""
    return documents.churn_document(
        _model_subjects(spark, d), key="customer", contract="contract", charge="monthly",
        blank_text="total_text", outcome="churn", categorical=["contract", *b.SERVICES],
        numeric=[*SUBJECT_NUMBERS, "total_charges"])

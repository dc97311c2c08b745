"""The driver tables read as the inputs of each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.ordered import row_position

# Fixed values of the bindings; the oracle SQL states the same ones.
MONEY = "decimal(18,2)"
CENTS = 100
DELIVERED = "F"
ESTIMATE_DAYS = 1000
CHURN_DAYS = 180
TRANSLATIONS = {"ECONOMY": "economy_goods", "STANDARD": "standard_goods",
                "MEDIUM": "medium_goods", "PROMO": "promotional_goods"}
SERVICES = {"svc_urgent": "1-URGENT", "svc_high": "2-HIGH", "svc_medium": "3-MEDIUM",
            "svc_unspecified": "4-NOT SPECIFIED", "svc_low": "5-LOW"}


def cents(amount: str) -> Column:
    """An amount with two decimals as a whole number of cents."""
    return F.rint(F.col(amount) * 100).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- marketplace ---------------------------------------------------------

def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
               .agg(F.max("l_shipdate").alias("shipped")))
    placed = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("purchased"))
    return placed.join(shipped, "order_id", "left").select(
        "order_id", "customer_id", "status", "purchased",
        F.when(F.col("shipped") >= F.col("purchased"), F.col("shipped")).alias("delivered"),
        (F.col("purchased") + F.expr(f"INTERVAL {ESTIMATE_DAYS} DAY")).alias("estimated"))


def orders_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without delivery dates, for reports that need none."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("purchased"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        cents("l_extendedprice").alias("price"), cents("l_quantity").alias("freight"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2").alias("order_id"),
        (F.floor("value") % 5 + 1).cast("int").alias("score"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category_name"))


def translations(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in TRANSLATIONS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(category_name, category_english)")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    return (table(spark, sf_dir, "customer").join(nation, "c_nationkey")
            .select(F.col("c_custkey").alias("customer_id"), "state"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count(F.lit(1)).alias("installments")))
    return (table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
            .select(F.col("o_orderpriority").alias("payment_type"), "installments",
                    cents("o_totalprice").alias("payment_value")))


# --- experiment ----------------------------------------------------------

def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: some users come twice and some see the other arm's page."""
    event = F.col("event_id")
    user = event - F.when((event % 97 == 0) & (event > 0), 1).otherwise(0)
    treated = F.col("user_id") % 2 == 1
    swapped = event % 75 == 0
    visits = table(spark, sf_dir, "events").select(
        user.alias("user_id"), "ts", "event_id",
        F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int")
        .alias("converted"))
    return visits.select(
        "*", F.concat(F.lit("exp_"), F.expr("user_id div 2") % 3).alias("experiment"),
        F.when(treated, "treatment").otherwise("control").alias("arm"),
        F.when(treated != swapped, "new_page").otherwise("old_page").alias("page"))


# --- equipment -----------------------------------------------------------

def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_readings(table(spark, sf_dir, "events"))


def device_readings(events: DataFrame) -> DataFrame:
    """Events as sensor readings; works on a batch and on a stream."""
    return events.select(
        "event_id", "ts", F.col("user_id").alias("device"),
        (100 - F.col("value") / 4).alias("health"),
        (F.col("event_id") % 23 + 40).cast("int").alias("torque"),
        (298 + (F.col("event_id") % 43) / 10).alias("temperature"))


def engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit"), "ts", "event_id",
        F.col("value").alias("s_1"),
        (F.col("event_id") % 23 + 40).cast("double").alias("s_2"),
        (F.col("event_id") % 43).cast("double").alias("s_3"))


def engine_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit and cycle, cycles numbered in time order."""
    numbered = row_position(engine_rows(spark, sf_dir), ["unit"], ["ts", "event_id"], out="cycle")
    return numbered.select("unit", "cycle", "s_1", "s_2", "s_3")


# --- scored sets ---------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("fleet"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("prob"),
        (F.col("value").cast(MONEY) * 12).cast("decimal(20,2)").alias("at_stake"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return (table(spark, sf_dir, "labels").join(docs, "doc_id")
            .select("doc_id", "lang", F.col("quality").alias("label"),
                    ((F.col("n_chars") % 50) / 50).alias("prob")))


# --- subjects ------------------------------------------------------------

def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders, shaped like a subscriber."""
    placed = table(spark, sf_dir, "orders")
    newest = placed.agg(F.max("o_orderdate")).scalar()
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    history = placed.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.max(month) - F.min(month)).alias("tenure"),
        F.max("o_orderdate").alias("last_order"),
        F.sum(cents("o_totalprice")).alias("total_cents"),
        *[F.when(F.max((F.col("o_orderpriority") == text).cast("int")) == 1, "Yes")
          .otherwise("No").alias(name) for name, text in SERVICES.items()])
    lapsed = F.col("last_order") < newest - F.expr(f"INTERVAL {CHURN_DAYS} DAY")
    return (table(spark, sf_dir, "customer").join(history, "c_custkey").select(
        F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("contract"),
        "tenure", *SERVICES,
        (F.col("total_cents") / CENTS / F.greatest("tenure", F.lit(1))).alias("monthly"),
        F.when(F.col("tenure") == 0, "  ").otherwise(F.concat(
            F.lit(" "), (F.col("total_cents").cast("decimal(20,0)") / CENTS).cast(MONEY)
            .cast("string"))).alias("total_text"),
        F.when(lapsed, "Yes").otherwise("No").alias("churn"))
        .withColumn("num_services", fx.count_yes(list(SERVICES))))

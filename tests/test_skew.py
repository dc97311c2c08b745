"""One key with a third of all rows: the plans split it, and the results stay the same."""

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import ordered
from fieldgauge.plans import marketplace as m

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    n = 60_000
    order = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000)
    product = F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 900)
    items = spark.range(n, numPartitions=16).select(
        order.alias("order_id"), product.alias("product_id"),
        (F.col("id") % 100).cast("decimal(18,2)").alias("price"),
        F.lit(1).cast("decimal(18,2)").alias("freight"))
    orders = spark.range(4000, numPartitions=4).select(
        F.col("id").alias("order_id"), F.lit("delivered").alias("status"),
        F.timestamp_seconds(F.col("id") * 1000).alias("purchased"),
        F.timestamp_seconds(F.col("id") * 1000 + 90000).alias("delivered"),
        F.timestamp_seconds(F.col("id") % 5 * 1000000).alias("estimated"))
    reviews = spark.range(30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000).alias("order_id"),
        (F.col("id") % 5 + 1).cast("int").alias("score"))
    products = spark.range(900).select(
        F.col("id").alias("product_id"),
        F.concat(F.lit("c"), F.col("id") % 6).alias("category_name"))
    names = spark.createDataFrame([("c0", "zero")], "category_name string, category_english string")
    return orders, items, products, names, reviews


def test_hot_order_and_product_are_split(small):
    got = m.category_risk(*tables(small), min_orders=1)
    plan = executed(got)
    assert "skew=true" in plan
    rows = sorted(map(tuple, got.collect()))
    small.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = m.category_risk(*tables(small), min_orders=1)
        assert sorted(map(tuple, plain.collect())) == rows
    finally:
        small.conf.set("spark.sql.adaptive.enabled", "true")
    # 20,000 items of the hot order times its 10,000 reviews are counted, never formed.
    weight = {r["category"]: r for r in got.collect()}
    assert float(sum(r["revenue"] for r in weight.values())) > 20_000 * 10_000


def test_hot_order_is_combined_before_the_shuffle(small):
    orders, items, _, _, reviews = tables(small)
    df = m.kpis(orders, items, reviews)
    plan = executed(df)
    assert plan.count("partial_count(1)") >= 2
    assert "skew=true" not in plan  # nothing left to split


def test_group_max_without_broadcast_splits_a_hot_unit(small, monkeypatch):
    monkeypatch.setattr(ordered.broadcast_if_small, "__defaults__", (1,))
    rows = small.range(200_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000).alias("unit"),
        F.col("id").alias("cycle"))
    df = ordered.with_group_max(rows, ["unit"], "cycle", "last")
    plan = executed(df)
    assert "skew=true" in plan
    assert df.filter("unit = 7").agg(F.min("last")).first()[0] == 199_998

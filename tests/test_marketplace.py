"""Reports against the plain joins they stand for, on awkward rows."""

import random

import pytest

from fieldgauge.plans import marketplace as m


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    def day(n):
        return f"2017-{1 + n // 28 % 12:02d}-{1 + n % 28:02d} 23:00:00"
    orders, items, reviews = [], [], []
    for i in range(200):
        bought = r.randrange(200)
        arrived = None if r.random() < 0.1 else day(bought + r.randrange(1, 30))
        due = arrived if arrived and r.random() < 0.2 else day(bought + 15)
        orders.append((i, i % 12, "open" if i % 9 == 0 else "delivered", day(bought), arrived,
                       due))
        for _ in range(r.randrange(4)):
            items.append((i, r.randrange(20), r.randrange(1, 9999) / 100,
                          None if r.random() < 0.1 else r.randrange(1, 999) / 100))
        for _ in range(r.randrange(3)):
            reviews.append((i, None if r.random() < 0.1 else r.randrange(1, 6)))
    # One order with a third of all items and of all reviews.
    items += [(4, r.randrange(20), 1.25, 0.5) for _ in range(len(items) // 2)]
    reviews += [(4, 1 + n % 5) for n in range(len(reviews) // 2)] + [(None, 3), (None, 4)]
    products = [(p, None if p == 3 else f"c{p % 5}") for p in range(19)]  # 19 has no product
    names = [("c0", "zero"), ("c1", "one")]
    customers = [(c, f"s{c % 3}") for c in range(11)]  # 11 has no customer
    t = {
        "orders": spark.createDataFrame(
            orders, "order_id long, customer_id long, status string, purchased string, "
                    "delivered string, estimated string").selectExpr(
            "order_id", "customer_id", "status", "timestamp(purchased) purchased",
            "timestamp(delivered) delivered", "timestamp(estimated) estimated"),
        "items": spark.createDataFrame(
            items, "order_id long, product_id long, price double, freight double").selectExpr(
            "order_id", "product_id", "decimal(price) p0",
            "cast(price as decimal(18,2)) price", "cast(freight as decimal(18,2)) freight")
        .drop("p0"),
        "reviews": spark.createDataFrame(reviews, "order_id long, score int"),
        "products": spark.createDataFrame(products, "product_id long, category_name string"),
        "translations": spark.createDataFrame(
            names, "category_name string, category_english string"),
        "customers": spark.createDataFrame(customers, "customer_id long, state string"),
    }
    for name, df in t.items():
        t[name] = df.repartition(3)
        t[name].createOrReplaceTempView(f"mk_{name}")
    return t


def close(got, want):
    a, b = sorted(map(tuple, got.collect()), key=repr), sorted(map(tuple, want.collect()), key=repr)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for u, v in zip(x, y, strict=True):
            if isinstance(u, str) or u is None:
                assert u == v
            else:
                assert float(u) == pytest.approx(float(v), rel=1e-9)


JOINED = ("FROM mk_orders o JOIN mk_items i ON o.order_id = i.order_id "
          "LEFT JOIN mk_reviews r ON o.order_id = r.order_id ")
LATE = "sum(CASE WHEN delivered > estimated THEN 1 ELSE 0 END)"


def test_kpis(spark, tables):
    t = tables
    close(m.kpis(t["orders"], t["items"], t["reviews"]), spark.sql(
        "SELECT count(DISTINCT o.order_id), sum(price + freight), avg(cast(price + freight as double)), "
        f"avg(cast(score as double)) {JOINED} WHERE status = 'delivered'"))


def test_kpis_count_each_row_once(spark, tables):
    t = tables
    close(m.kpis(t["orders"], t["items"], t["reviews"], "dedup"), spark.sql(
        "WITH l AS (SELECT i.* FROM mk_orders o JOIN mk_items i USING (order_id) "
        "WHERE status = 'delivered') "
        "SELECT count(DISTINCT order_id), sum(price + freight), avg(cast(price + freight as double)), "
        "(SELECT avg(cast(score as double)) FROM mk_reviews "
        " WHERE order_id IN (SELECT order_id FROM l)) FROM l"))


def test_category(spark, tables):
    t = tables
    got = m.category_risk(t["orders"], t["items"], t["products"], t["translations"],
                          t["reviews"], min_orders=1, top=4)
    close(got, spark.sql(
        "SELECT coalesce(category_english, p.category_name, 'unknown') c, sum(price) rev, "
        f"count(DISTINCT o.order_id) n, 100D * {LATE} / count(*), avg(cast(score as double)) "
        "FROM mk_orders o JOIN mk_items i ON o.order_id = i.order_id "
        "JOIN mk_products p ON i.product_id = p.product_id "
        "LEFT JOIN mk_translations x ON p.category_name = x.category_name "
        "LEFT JOIN mk_reviews r ON o.order_id = r.order_id "
        "WHERE status = 'delivered' GROUP BY 1 HAVING n >= 1 ORDER BY rev DESC LIMIT 4"))
    full = m.category_risk(t["orders"], t["items"], t["products"], t["translations"],
                           t["reviews"], min_orders=1)
    assert "unknown" in {r["category"] for r in full.collect()}


def test_state(spark, tables):
    t = tables
    got = m.state_performance(t["orders"], t["items"], t["customers"], t["reviews"],
                              min_orders=1)
    close(got.drop("risk_tag"), spark.sql(
        "SELECT state, sum(price + freight), count(DISTINCT o.order_id), "
        "avg(datediff(delivered, purchased)), avg(cast(score as double)) "
        "FROM mk_orders o JOIN mk_items i ON o.order_id = i.order_id "
        "JOIN mk_customers c ON o.customer_id = c.customer_id "
        "LEFT JOIN mk_reviews r ON o.order_id = r.order_id "
        "WHERE status = 'delivered' AND delivered IS NOT NULL GROUP BY state"))


def test_status_and_effect(spark, tables):
    t = tables
    close(m.delivery_vs_reviews(t["orders"], t["reviews"]), spark.sql(
        "SELECT CASE WHEN delivered IS NULL THEN 'Not Delivered' "
        "WHEN delivered > estimated THEN 'Late' ELSE 'On Time' END s, "
        "avg(cast(score as double)), count(DISTINCT o.order_id) FROM mk_orders o "
        "LEFT JOIN mk_reviews r ON o.order_id = r.order_id WHERE status = 'delivered' GROUP BY s"))
    by = {r["delivery_status"]: r for r in m.delivery_vs_reviews(t["orders"],
                                                                 t["reviews"]).collect()}
    e = m.late_effect(t["orders"], t["reviews"]).first()
    assert e["score_drop"] == by["On Time"][1] - by["Late"][1]


def test_months(spark, tables):
    t = tables
    rows = m.revenue_late_trend(t["orders"], t["items"], 1).collect()
    assert [r["month"] for r in rows] == sorted(r["month"] for r in rows)
    assert {r["month"]: float(r["revenue"]) for r in rows} == {
        r[0]: pytest.approx(float(r[1])) for r in spark.sql(
            "SELECT date_format(purchased, 'yyyy-MM'), sum(price + freight) FROM mk_orders "
            "JOIN mk_items USING (order_id) WHERE status = 'delivered' GROUP BY 1").collect()}
    assert m.revenue_late_trend(t["orders"], t["items"], 10 ** 6).count() == 0


def test_payments_leave_out_undefined_and_missing(spark):
    df = spark.createDataFrame(
        [("card", 2, 10), ("card", None, 5), ("not_defined", 1, 0), (None, 1, 7)],
        "payment_type string, installments int, payment_value int")
    assert [tuple(r) for r in m.payment_breakdown(df).collect()] == [("card", 2, 2.0, 15)]


def test_unknown_mode(tables):
    with pytest.raises(ValueError):
        m.kpis(tables["orders"], tables["items"], tables["reviews"], "other")


def test_items_and_reviews_never_meet_row_by_row(spark, tables):
    """Without broadcasts: both sides are summed per order before the join."""
    t = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = m.kpis(t["orders"], t["items"], t["reviews"])._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # orders, items and reviews each move once; the joins and the distinct count reuse it.
    assert plan.count("Exchange hashpartitioning(order_id") == 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

"""Marketplace reports.

Reviews are 0..n and items 1..n per order, and the reports join both before they aggregate.
Sums over that join follow from per-order totals: an item counts once per review row of its
order, and a review once per item. So each side is summed per order before any join, and no
plan ever holds the items x reviews rows. Orders hold one row per order.

``mode='as_joined'`` keeps the join's repeated counting; ``mode='dedup'`` counts every item
and every review once.

Amounts may be decimals, or whole numbers of a minor unit (cents), which sum several times
faster; ``minor_units`` then says how many make one. Sums stay exact either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.quality import min_volume

# Status names, limits of the reports and digits of their figures.
DELIVERED = "delivered"
MIN_CATEGORY_ORDERS = 100
MIN_STATE_ORDERS = 50
MIN_MONTH_ORDERS = 100
TOP_CATEGORIES = 15
UNDEFINED_PAYMENT = "not_defined"
DIGITS = {"total_revenue": 2, "avg_order_item_value": 2, "avg_review_score": 2, "revenue": 2,
          "late_pct": 2, "avg_delivery_days": 1, "avg_installments": 1, "total_value": 2}


def rounded(df: DataFrame, digits: dict[str, int] = DIGITS) -> DataFrame:
    """Report figures rounded half up, as printed."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


def delivered_only(orders: DataFrame, delivered: str) -> DataFrame:
    return orders.filter(F.col("status") == delivered)


def _check(mode: str) -> bool:
    if mode not in ("as_joined", "dedup"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "as_joined"


def review_totals(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_rows"), F.count("score").alias("review_n"),
        F.sum("score").alias("review_sum"))


def item_totals(items: DataFrame) -> DataFrame:
    amount = F.col("price") + F.col("freight")
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_rows"), F.count(amount).alias("amount_n"),
        F.sum(amount).alias("amount_sum"))


def with_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Left-join review totals; an order without reviews still fills one joined row."""
    joined = rows.join(review_totals(reviews), "order_id", "left")
    return joined.withColumns({
        "weight": F.coalesce(F.col("review_rows"), F.lit(1)),
        "review_n": F.coalesce(F.col("review_n"), F.lit(0)),
        "review_sum": F.coalesce(F.col("review_sum"), F.lit(0))})


def _repeated(total: str, repeats: str | None) -> Column:
    """A per-order count or score sum, counted repeatedly.

    As double: exact to 2**53, and past that a ratio of two of them still is to 15 digits,
    while a whole-number product would overflow for a huge order paired with itself.
    """
    value = F.col(total).cast("double")
    return F.sum(value if repeats is None else value * F.col(repeats).cast("double"))


def _money(amount: str, repeats: str | None, minor_units: int) -> Column:
    """An exact total of amounts."""
    wide = F.col(amount).cast("decimal(38,2)")
    total = F.sum(wide if repeats is None else wide * F.col(repeats).cast("decimal(20,0)"))
    return (total / minor_units if minor_units != 1 else total).cast("decimal(38,2)")


def _order_measures(as_joined: bool, minor_units: int) -> dict[str, Column]:
    """Revenue, item value and review score from rows that hold per-order totals."""
    weight, repeat = ("weight", "item_rows") if as_joined else (None, None)
    revenue = _money("amount_sum", weight, minor_units)
    return {
        "revenue": revenue,
        "item_value": fx.ratio(revenue, _repeated("amount_n", weight)),
        "score": fx.ratio(_repeated("review_sum", repeat), _repeated("review_n", repeat))}


def kpis(orders: DataFrame, items: DataFrame, reviews: DataFrame,
         mode: str = "as_joined", *, delivered: str = DELIVERED,
         minor_units: int = 1) -> DataFrame:
    """Delivered orders, revenue, mean item value and mean review score."""
    m = _order_measures(_check(mode), minor_units)
    rows = delivered_only(orders, delivered).select("order_id").join(item_totals(items), "order_id")
    return with_reviews(rows, reviews).agg(
        F.count("order_id").alias("total_orders"),
        m["revenue"].alias("total_revenue"),
        m["item_value"].alias("avg_order_item_value"),
        m["score"].alias("avg_review_score"))


def monthly_revenue(orders: DataFrame, items: DataFrame, *,
                    delivered: str = DELIVERED, minor_units: int = 1) -> DataFrame:
    rows = (delivered_only(orders, delivered).select("order_id", fx.month_key("purchased").alias("month"))
            .join(item_totals(items), "order_id"))
    return rows.groupBy("month").agg(
        _money("amount_sum", None, minor_units).alias("revenue"),
        F.count("order_id").alias("orders")).orderBy("month")


def delivery_vs_reviews(orders: DataFrame, reviews: DataFrame, *,
                        delivered: str = DELIVERED) -> DataFrame:
    """Mean review score by delivery status."""
    rows = delivered_only(orders, delivered).select(
        "order_id", fx.delivery_status("delivered", "estimated").alias("delivery_status"))
    return with_reviews(rows, reviews).groupBy("delivery_status").agg(
        fx.ratio(F.sum("review_sum"), F.sum("review_n")).alias("avg_review_score"),
        F.count("order_id").alias("order_count")).orderBy(
        F.desc_nulls_last("avg_review_score"), "delivery_status")


def late_rate_trend(orders: DataFrame, *, delivered: str = DELIVERED) -> DataFrame:
    late = fx.late_flag("delivered", "estimated")
    return delivered_only(orders, delivered).groupBy(fx.month_key("purchased").alias("month")).agg(
        fx.share_percent(F.sum(late), F.count(F.lit(1))).alias("late_pct")).orderBy("month")


def category_risk(orders: DataFrame, items: DataFrame, products: DataFrame,
                  translations: DataFrame, reviews: DataFrame, *, mode: str = "as_joined",
                  min_orders: int = MIN_CATEGORY_ORDERS, top: int = TOP_CATEGORIES,
                  delivered: str = DELIVERED, minor_units: int = 1) -> DataFrame:
    """Top categories by revenue, with late share and mean review score."""
    as_joined = _check(mode)
    # Names are looked up on the product side, so that items are joined only once.
    named_products = products.join(translations, "category_name", "left").select(
        "product_id", fx.first_known("category_english", "category_name").alias("category"))
    named = (items.select("order_id", "product_id", "price")
             .join(named_products, "product_id").drop("product_id"))
    placed = delivered_only(orders, delivered).select(
        "order_id", fx.late_flag("delivered", "estimated").alias("late"))
    rows = with_reviews(placed, reviews).join(named, "order_id")
    # Rows already lie together by order, so this takes no shuffle; each order then counts once.
    per_order = rows.groupBy("order_id", "category").agg(
        F.count(F.lit(1)).alias("item_rows"), F.sum("price").alias("amount_sum"),
        *[F.max(c).alias(c) for c in ("late", "weight", "review_n", "review_sum")])
    weight, repeat = ("weight", "item_rows") if as_joined else (None, None)
    rows = F.col("item_rows").cast("double") * F.col("weight") if as_joined else F.lit(1)
    report = per_order.groupBy("category").agg(
        _money("amount_sum", weight, minor_units).alias("revenue"),
        F.count(F.lit(1)).alias("order_count"),
        fx.share_percent(F.sum(F.col("late") * rows), F.sum(rows)).alias("late_pct"),
        fx.ratio(_repeated("review_sum", repeat), _repeated("review_n", repeat))
        .alias("avg_review_score"))
    return (min_volume(report, "order_count", min_orders)
            .orderBy(F.desc("revenue"), "category").limit(top))


def state_performance(orders: DataFrame, items: DataFrame, customers: DataFrame,
                      reviews: DataFrame, *, mode: str = "as_joined",
                      min_orders: int = MIN_STATE_ORDERS,
                      delivered: str = DELIVERED, minor_units: int = 1,
                      top: int | None = None) -> DataFrame:
    """Revenue, delivery days and review score by customer state, with a risk tag; the tag
    follows the figure shown, which has one decimal. ``top`` keeps the states of most revenue."""
    as_joined = _check(mode)
    m = _order_measures(as_joined, minor_units)
    placed = (delivered_only(orders, delivered).filter(F.col("delivered").isNotNull())
              .select("order_id", "customer_id",
                      fx.days_between("purchased", "delivered").alias("days")))
    # Everything by order first, so that orders are shuffled by customer only once, at the end.
    rows = with_reviews(placed.join(item_totals(items), "order_id"), reviews) \
        .join(customers, "customer_id")
    joined_rows = F.col("item_rows").cast("double") * F.col("weight") if as_joined else F.lit(1)
    report = rows.groupBy("state").agg(
        m["revenue"].alias("revenue"),
        F.count("order_id").alias("order_count"),
        fx.ratio(F.sum(F.col("days") * joined_rows), F.sum(joined_rows))
        .alias("avg_delivery_days"),
        m["score"].alias("avg_review_score"))
    ranked = (min_volume(report, "order_count", min_orders)
              .withColumn("risk_tag", fx.delivery_risk_tag(F.round("avg_delivery_days", 1)))
              .orderBy(F.desc("revenue"), "state"))
    return ranked if top is None else ranked.limit(top)


def payment_breakdown(payments: DataFrame, undefined: str = UNDEFINED_PAYMENT, *,
                      minor_units: int = 1) -> DataFrame:
    """Payments by type; a missing type is left out like the undefined one."""
    return payments.filter(F.col("payment_type") != undefined).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("payments"),
        fx.ratio(F.sum("installments"), F.count("installments")).alias("avg_installments"),
        _money("payment_value", None, minor_units).alias("total_value")).orderBy(
        F.desc("total_value"), "payment_type")


def revenue_late_trend(orders: DataFrame, items: DataFrame,
                       min_orders: int = MIN_MONTH_ORDERS, *,
                       delivered: str = DELIVERED, minor_units: int = 1) -> DataFrame:
    """Monthly revenue beside the late rate, without low-volume months."""
    revenue = min_volume(monthly_revenue(orders, items, delivered=delivered,
                                         minor_units=minor_units), "orders", min_orders)
    return revenue.join(late_rate_trend(orders, delivered=delivered), "month", "left").orderBy("month")


def late_effect(orders: DataFrame, reviews: DataFrame, *,
                delivered: str = DELIVERED) -> DataFrame:
    """How far a late delivery lowers the score, and the share of late orders."""
    by_status = delivery_vs_reviews(orders, reviews, delivered=delivered)
    status = F.col("delivery_status")
    def pick(name, column):
        return F.max(F.when(status == name, F.col(column)))
    return by_status.agg(
        pick(fx.ON_TIME, "avg_review_score").alias("on_time_score"),
        pick(fx.LATE, "avg_review_score").alias("late_score"),
        (pick(fx.ON_TIME, "avg_review_score") - pick(fx.LATE, "avg_review_score"))
        .alias("score_drop"),
        fx.share_percent(F.coalesce(pick(fx.LATE, "order_count"), F.lit(0)),
                         F.sum("order_count")).alias("late_share_pct"))

"""The same questions in DuckDB SQL, written as plainly as possible.

The SQL joins row by row and pairs rows with thresholds where the library avoids both, so a
match checks the rewrite and not only the arithmetic.
"""

from __future__ import annotations

from fieldgauge import bindings as b
from fieldgauge.functions import columns as fx, normal
from fieldgauge.operators import decision

DONE = f"status = '{b.DELIVERED}'"

# --- inputs ---------------------------------------------------------------

ORD = f"""
shipped AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
         o_orderdate AS purchased,
         CASE WHEN shipped >= o_orderdate THEN shipped END AS delivered,
         o_orderdate + INTERVAL {b.ESTIMATE_DAYS} DAY AS estimated
  FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey)"""
ITEM = """
item AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l_quantity AS DECIMAL(18,2)) AS freight
  FROM lineitem)"""
REV = """
rev AS (
  SELECT event_id // 2 AS order_id, CAST(floor(value) AS BIGINT) % 5 + 1 AS score FROM events)"""
LATE = "CASE WHEN delivered IS NOT NULL AND delivered > estimated THEN 1 ELSE 0 END"


def mean(value: str, weight: str | None = None) -> str:
    whole = weight or f"count({value})"
    return f"CAST(sum({value}) AS DOUBLE) / {whole}"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


SQL: dict[str, str] = {}

# --- marketplace ----------------------------------------------------------

SQL["kpis"] = f"""
WITH {ORD}, {ITEM}, {REV}
SELECT count(DISTINCT o.order_id) AS total_orders,
       {dbl('sum(price + freight)')} AS total_revenue,
       {mean('price + freight')} AS avg_order_item_value,
       {mean('score')} AS avg_review_score
FROM ord o JOIN item i ON o.order_id = i.order_id LEFT JOIN rev r ON o.order_id = r.order_id
WHERE {DONE}"""

SQL["kpis_dedup"] = f"""
WITH {ORD}, {ITEM}, {REV},
lines AS (SELECT i.* FROM ord o JOIN item i ON o.order_id = i.order_id WHERE {DONE}),
scores AS (SELECT score FROM rev WHERE order_id IN (SELECT order_id FROM lines))
SELECT (SELECT count(DISTINCT order_id) FROM lines) AS total_orders,
       (SELECT {dbl('sum(price + freight)')} FROM lines) AS total_revenue,
       (SELECT {mean('price + freight')} FROM lines) AS avg_order_item_value,
       (SELECT {mean('score')} FROM scores) AS avg_review_score"""

MONTHLY = f"""
SELECT strftime(purchased, '%Y-%m') AS month, {dbl('sum(price + freight)')} AS revenue,
       count(DISTINCT o.order_id) AS orders
FROM ord o JOIN item i ON o.order_id = i.order_id
WHERE {DONE} GROUP BY month"""
TREND = f"""
SELECT strftime(purchased, '%Y-%m') AS month,
       100.0::DOUBLE * sum({LATE}) / count(*) AS late_pct
FROM ord WHERE {DONE} GROUP BY month"""
STATUS = f"""
SELECT CASE WHEN delivered IS NULL THEN 'Not Delivered'
            WHEN delivered > estimated THEN 'Late' ELSE 'On Time' END AS delivery_status,
       {mean('score')} AS avg_review_score, count(DISTINCT o.order_id) AS order_count
FROM ord o LEFT JOIN rev r ON o.order_id = r.order_id
WHERE {DONE} GROUP BY delivery_status"""

SQL["monthly_revenue"] = f"WITH {ORD}, {ITEM} {MONTHLY}"
SQL["late_rate_trend"] = f"WITH {ORD} {TREND}"
SQL["delivery_vs_reviews"] = f"WITH {ORD}, {REV} {STATUS}"
SQL["revenue_late_trend"] = f"""
WITH {ORD}, {ITEM}, revenue AS ({MONTHLY}), late AS ({TREND})
SELECT month, revenue, orders, late_pct FROM revenue LEFT JOIN late USING (month)
WHERE orders >= 60"""
SQL["late_effect"] = f"""
WITH {ORD}, {REV}, s AS ({STATUS}),
p AS (SELECT max(avg_review_score) FILTER (delivery_status = 'On Time') AS on_time_score,
             max(avg_review_score) FILTER (delivery_status = 'Late') AS late_score,
             100.0::DOUBLE * max(order_count) FILTER (delivery_status = 'Late')
               / sum(order_count) AS late_share_pct FROM s)
SELECT on_time_score, late_score, on_time_score - late_score AS score_drop, late_share_pct
FROM p"""

_names = ", ".join(f"('{k}', '{v}')" for k, v in b.TRANSLATIONS.items())
CATEGORY = f"""
names AS (SELECT * FROM (VALUES {_names}) t(category_name, category_english)),
named AS (SELECT i.order_id, price, coalesce(category_english, p_type, 'unknown') AS category
          FROM item i JOIN part ON product_id = p_partkey
          LEFT JOIN names ON p_type = category_name)"""
SQL["category_risk"] = f"""
WITH {ORD}, {ITEM}, {REV}, {CATEGORY}
SELECT category, {dbl('sum(price)')} AS revenue, count(DISTINCT o.order_id) AS order_count,
       100.0::DOUBLE * sum({LATE}) / count(*) AS late_pct, {mean('score')} AS avg_review_score
FROM ord o JOIN named n ON o.order_id = n.order_id LEFT JOIN rev r ON o.order_id = r.order_id
WHERE {DONE} GROUP BY category HAVING count(DISTINCT o.order_id) >= 2400
ORDER BY revenue DESC, category LIMIT 15"""
SQL["category_risk_dedup"] = f"""
WITH {ORD}, {ITEM}, {REV}, {CATEGORY},
lines AS (SELECT category, price, o.order_id, {LATE} AS late
          FROM ord o JOIN named n ON o.order_id = n.order_id WHERE {DONE}),
pairs AS (SELECT DISTINCT category, order_id, late FROM lines),
money AS (SELECT category, {dbl('sum(price)')} AS revenue FROM lines GROUP BY category),
lateness AS (SELECT category, count(*) AS order_count,
                    100.0::DOUBLE * sum(late) / count(*) AS late_pct
             FROM pairs GROUP BY category),
opinion AS (SELECT category, {mean('score')} AS avg_review_score
            FROM pairs LEFT JOIN rev USING (order_id) GROUP BY category)
SELECT category, revenue, order_count, late_pct, avg_review_score
FROM money JOIN lateness USING (category) JOIN opinion USING (category)
WHERE order_count >= 2400 ORDER BY revenue DESC, category LIMIT 15"""

STATE = """
cust AS (SELECT c_custkey AS customer_id, n_name AS state
         FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TAG = "CASE WHEN round(avg_delivery_days, 1) > 14 THEN 'High Delivery Time' ELSE 'Healthy' END AS risk_tag"
SQL["state_performance"] = f"""
WITH {ORD}, {ITEM}, {REV}, {STATE},
t AS (
  SELECT state, {dbl('sum(price + freight)')} AS revenue,
         count(DISTINCT o.order_id) AS order_count,
         {mean("date_diff('day', purchased, delivered)")} AS avg_delivery_days,
         {mean('score')} AS avg_review_score
  FROM ord o JOIN item i ON o.order_id = i.order_id JOIN cust USING (customer_id)
  LEFT JOIN rev r ON o.order_id = r.order_id
  WHERE {DONE} AND delivered IS NOT NULL
  GROUP BY state HAVING count(DISTINCT o.order_id) >= 150)
SELECT *, {TAG} FROM t"""
SQL["top_states"] = f"""
WITH {ORD}, {ITEM}, {REV}, {STATE},
t AS (
  SELECT state, {dbl('sum(price + freight)')} AS revenue,
         count(DISTINCT o.order_id) AS order_count,
         {mean("date_diff('day', purchased, delivered)")} AS avg_delivery_days,
         {mean('score')} AS avg_review_score
  FROM ord o JOIN item i ON o.order_id = i.order_id JOIN cust USING (customer_id)
  LEFT JOIN rev r ON o.order_id = r.order_id
  WHERE {DONE} AND delivered IS NOT NULL
  GROUP BY state)
SELECT *, {TAG} FROM t ORDER BY revenue DESC, state LIMIT 3"""
SQL["state_performance_dedup"] = f"""
WITH {ORD}, {ITEM}, {REV}, {STATE},
sums AS (SELECT order_id, sum(price + freight) AS amount FROM item GROUP BY order_id),
placed AS (SELECT order_id, state, amount, date_diff('day', purchased, delivered) AS days
           FROM ord JOIN sums USING (order_id) JOIN cust USING (customer_id)
           WHERE {DONE} AND delivered IS NOT NULL),
opinion AS (SELECT state, {mean('score')} AS avg_review_score
            FROM placed LEFT JOIN rev USING (order_id) GROUP BY state),
t AS (SELECT state, {dbl('sum(amount)')} AS revenue, count(*) AS order_count,
             {mean('days')} AS avg_delivery_days FROM placed GROUP BY state
      HAVING count(*) >= 150)
SELECT state, revenue, order_count, avg_delivery_days, avg_review_score, {TAG}
FROM t JOIN opinion USING (state)"""

SQL["payment_breakdown"] = f"""
WITH n AS (SELECT l_orderkey, count(*) AS installments FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority AS payment_type, count(*) AS payments,
       {mean('installments')} AS avg_installments,
       {dbl('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total_value
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey
WHERE o_orderpriority != '4-NOT SPECIFIED' GROUP BY o_orderpriority"""

# --- experiment -----------------------------------------------------------

VISIT = """
ident AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type = 'purchase' AS converted,
         event_id - CASE WHEN event_id % 97 = 0 AND event_id > 0 THEN 1 ELSE 0 END AS user_id
  FROM events),
visit AS (
  SELECT *, 'exp_' || ((user_id // 2) % 3) AS experiment,
         CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm,
         CASE WHEN (user_id % 2 = 1) != (event_id % 75 = 0)
              THEN 'new_page' ELSE 'old_page' END AS page
  FROM ident),
fitting AS (
  SELECT * FROM visit
  WHERE (arm = 'control' AND page = 'old_page') OR (arm = 'treatment' AND page = 'new_page')),
clean AS (
  SELECT * FROM fitting
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)"""
ARMS = """
arms AS (
  SELECT experiment, count(*) FILTER (arm = 'control') AS n_control,
         count(*) FILTER (arm = 'treatment') AS n_treatment,
         count(*) FILTER (arm = 'control' AND converted) AS conversions_control,
         count(*) FILTER (arm = 'treatment' AND converted) AS conversions_treatment
  FROM clean GROUP BY experiment),
rates AS (
  SELECT *, CAST(conversions_control AS DOUBLE) / n_control AS pc,
         CAST(conversions_treatment AS DOUBLE) / n_treatment AS pt,
         CAST(conversions_control + conversions_treatment AS DOUBLE)
           / (n_control + n_treatment) AS pooled FROM arms)"""

# Upper normal tail from the power series of the distribution function:
# 1/2 - density(x) * sum of x^(2k+1) / (1*3*5*...*(2k+1)).
def tail(x: str) -> str:
    return (f"(0.5::DOUBLE - exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform("
            f"range(0, 150), lambda k: pow({x}, 2 * k + 1) * exp(k * ln(2) + lgamma(k + 1)"
            f" - lgamma(2 * k + 2)))))")


SQL["experiment_profile"] = f"""
WITH {VISIT},
raw AS (SELECT experiment, count(*) AS raw_rows,
               count(*) FILTER ((arm = 'control' AND page = 'new_page')
                 OR (arm = 'treatment' AND page = 'old_page')) AS mismatched_rows,
               count(*) - count(DISTINCT user_id) AS duplicate_rows
        FROM visit GROUP BY experiment),
kept AS (SELECT experiment, count(*) AS clean_rows FROM clean GROUP BY experiment)
SELECT experiment, raw_rows, mismatched_rows, duplicate_rows, clean_rows,
       raw_rows - clean_rows AS rows_removed,
       100.0::DOUBLE * mismatched_rows / raw_rows AS mismatched_pct,
       100.0::DOUBLE * clean_rows / raw_rows AS retained_pct
FROM raw JOIN kept USING (experiment)"""
SQL["experiment_arms_clean"] = f"""
WITH {VISIT}, {ARMS}
SELECT experiment, n_control, n_treatment, conversions_control, conversions_treatment
FROM arms"""
SQL["experiment_clean_rows"] = f"""
WITH {VISIT}
SELECT user_id, event_id, experiment, arm, {big('converted')} AS converted FROM clean"""
SQL["duplicate_users"] = f"""
WITH {VISIT}
SELECT arm, count(*) - count(DISTINCT user_id) AS duplicate_rows FROM visit GROUP BY arm"""

_half = "((n_control + n_treatment) / 2.0::DOUBLE)"
SRM = f"""
srm AS (SELECT experiment, {_half} AS expected_per_arm,
               pow(n_control - {_half}, 2) / {_half}
                 + pow(n_treatment - {_half}, 2) / {_half} AS chi2 FROM arms)"""
SQL["experiment_srm"] = f"""
WITH {VISIT}, {ARMS}, {SRM}, p AS (SELECT *, 2 * {tail('sqrt(chi2)')} AS p FROM srm)
SELECT experiment, expected_per_arm, round(chi2, 8) AS srm_chi2, round(p, 8) AS srm_p_value,
       p > 0.01 AS srm_passed FROM p"""

ZTEST = """
test AS (
  SELECT experiment, pc, pt, pt - pc AS diff, (pt - pc) / pc * 100 AS rel,
         (pt - pc) / sqrt(pooled * (1 - pooled)
           * (1.0::DOUBLE / n_control + 1.0::DOUBLE / n_treatment)) AS z,
         sqrt(pc * (1 - pc) / n_control + pt * (1 - pt) / n_treatment) AS se FROM rates)"""
SQL["experiment_ztest"] = f"""
WITH {VISIT}, {ARMS}, {ZTEST}, p AS (SELECT *, {tail('z')} AS p FROM test)
SELECT experiment, round(pc, 8) AS control_rate, round(pt, 8) AS treatment_rate,
       round(diff, 8) AS absolute_diff, round(rel, 8) AS relative_diff_pct,
       round(z, 8) AS z_statistic, round(diff - 1.96 * se, 8) AS ci_low,
       round(diff + 1.96 * se, 8) AS ci_high, round(p, 8) AS p_value, p < 0.05 AS significant
FROM p"""

_z = "1.959963984540054e0"  # the two-sided 5 % point
POWER = """
effect AS (
  SELECT experiment, 2 * asin(sqrt(pt)) - 2 * asin(sqrt(pc)) AS h,
         (2 * asin(sqrt(pt)) - 2 * asin(sqrt(pc)))
           / sqrt(1.0::DOUBLE / n_control + 1.0::DOUBLE / n_treatment) AS shift FROM rates)"""
_power = f"{tail(f'({_z} - shift)')} + {tail(f'({_z} + shift)')}"
SQL["experiment_power"] = f"""
WITH {VISIT}, {ARMS}, {POWER}
SELECT experiment, round(h, 8) AS effect_size, round({_power}, 8) AS achieved_power
FROM effect"""


def grid(points: tuple[float, float, int]) -> str:
    return "[" + ", ".join(f"{v!r}e0" for v in fx.linspace(*points)) + "]"


SQL["experiment_mde"] = f"""
WITH {VISIT}, {ARMS},
lifts AS (SELECT unnest({grid((0.001, 0.2, 200))}) AS lift),
seen AS (
  SELECT experiment, lift, (2 * asin(sqrt(pc + lift)) - 2 * asin(sqrt(pc)))
           * sqrt(n_control / 2.0::DOUBLE) AS shift
  FROM rates, lifts WHERE pc + lift <= 1),
strong AS (SELECT experiment, lift FROM seen WHERE {_power} >= 0.8)
SELECT experiment, n_control, min(lift) AS minimum_detectable_lift
FROM rates LEFT JOIN strong USING (experiment) GROUP BY experiment, n_control"""

SQL["experiment_verdict"] = f"""
WITH {VISIT}, {ARMS}, {SRM}, {ZTEST}, {POWER},
raw AS (SELECT experiment, count(*) AS raw_rows FROM visit GROUP BY experiment),
kept AS (SELECT experiment, count(*) AS clean_rows FROM clean GROUP BY experiment)
SELECT experiment, raw_rows, raw_rows - clean_rows AS rows_removed, round(chi2, 4) AS srm_chi2,
       2 * {tail('sqrt(chi2)')} > 0.01 AS srm_passed, round(diff, 5) AS absolute_diff,
       round(z, 4) AS z_statistic, round({tail('z')}, 4) AS p_value,
       {tail('z')} < 0.05 AS significant, round({_power}, 4) AS achieved_power
FROM raw JOIN kept USING (experiment) JOIN srm USING (experiment) JOIN test USING (experiment)
JOIN effect USING (experiment)"""

_rate = "CAST(sum({0}) FILTER (arm = '{1}') AS DOUBLE) / count(*) FILTER (arm = '{1}')"
_c, _t = (_rate.format(big("converted"), a) for a in ("control", "treatment"))
SQL["experiment_daily"] = f"""
WITH {VISIT}
SELECT CAST(day AS VARCHAR) AS date, {_c} AS control_rate, {_t} AS treatment_rate,
       count(*) FILTER (arm = 'control') AS control_n,
       count(*) FILTER (arm = 'treatment') AS treatment_n
FROM clean GROUP BY day"""
SQL["experiment_daily_pivot"] = f"""
WITH {VISIT}
SELECT experiment, CAST(day AS VARCHAR) AS date, {_c} AS control_rate, {_t} AS treatment_rate
FROM clean GROUP BY experiment, day"""

# --- equipment series -----------------------------------------------------

SERIES = """
series AS (
  SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
         value AS s_1, CAST(event_id % 23 + 40 AS DOUBLE) AS s_2,
         CAST(event_id % 43 AS DOUBLE) AS s_3
  FROM events)"""
READING = """
reading AS (
  SELECT event_id, ts, user_id AS device,
         100 - value / 4 AS health, event_id % 23 + 40 AS torque,
         298 + (event_id % 43) / 10.0::DOUBLE AS temperature
  FROM events)"""
LIFE = "least(max(cycle) OVER (PARTITION BY unit) - cycle, 50)"


def rolling(column: str) -> str:
    """Mean of the last five rows, added up oldest first."""
    w = "OVER (PARTITION BY unit ORDER BY cycle)"
    earlier = " + ".join(f"coalesce(lag({column}, {k}) {w}, 0)" for k in (4, 3, 2, 1))
    return f"({earlier} + {column}) / least(cycle, 5)"


SQL["rul_labels"] = f"WITH {SERIES} SELECT unit, cycle, {LIFE} AS \"RUL\" FROM series"
SQL["rolling_features"] = f"""
WITH {SERIES}
SELECT unit, cycle, {', '.join(f'{dbl(s)} AS {s}, {rolling(s)} AS {s}_roll_mean'
                               for s in ('s_1', 's_2', 's_3'))} FROM series"""
SQL["last_observation"] = f"""
WITH {SERIES}
SELECT unit, cycle, {dbl('s_1')} AS s_1, {dbl('s_2')} AS s_2, {dbl('s_3')} AS s_3 FROM series
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1"""
_last_readings = f"""
WITH {READING}
SELECT device, event_id, {dbl('health')} AS health, torque, {dbl('temperature')} AS temperature
FROM reading
QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) <= """
SQL["last_n_buffer"] = _last_readings + "20"
SQL["stream_buffer"] = _last_readings + "20"
SQL["latest_reading"] = _last_readings + "1"
SQL["sensor_unpivot"] = f"""
WITH {SERIES}
SELECT unit, cycle, 's_1' AS variable, {dbl('s_1')} AS value FROM series
UNION ALL SELECT unit, cycle, 's_2', {dbl('s_2')} FROM series"""

PAIRS = f"""
pairs AS (SELECT unit, cycle, {dbl(LIFE)} AS life, {rolling('s_1')} / 4 + 5 AS pred FROM series)"""
_penalty = ("CASE WHEN pred < life THEN exp(-(pred - life) / 13) - 1 "
            "ELSE exp((pred - life) / 10) - 1 END")
_metrics = f"""count(*) AS n, round(sqrt(avg(pow(pred - life, 2))), 6) AS rmse,
       round(avg(abs(pred - life)), 6) AS mae,
       round(1 - sum(pow(pred - life, 2)) / (var_pop(life) * count(*)), 6) AS r2,
       round(sum({_penalty}), 6) AS late_penalty_score"""
SQL["regression_metrics"] = f"WITH {SERIES}, {PAIRS} SELECT {_metrics} FROM pairs"
SQL["regression_metrics_by_split"] = f"""
WITH {SERIES}, {PAIRS}
SELECT CASE WHEN unit % 4 = 0 THEN 'held_out' ELSE 'in_sample' END AS split, {_metrics}
FROM pairs GROUP BY split"""
SQL["late_penalty_score"] = f"""
WITH {SERIES}, {PAIRS} SELECT unit, round(sum({_penalty}), 6) AS score FROM pairs GROUP BY unit"""
SQL["failure_scores"] = f"""
WITH {SERIES}, {PAIRS},
last AS (SELECT * FROM pairs
         QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1)
SELECT unit, life AS "RUL", round(pred, 9) AS "predicted_RUL",
       round(1 - least(greatest(pred / 50, 0), 1), 9) AS failure_probability,
       {big('life <= 20')} AS actual_failure_soon FROM last"""

SQL["request_errors"] = """
SELECT CASE WHEN event_id % 40 < 1 THEN 'cycle must be 1 or more'
            WHEN event_id % 50 = 0 THEN 's_1 is missing' ELSE 'none' END AS error,
       count(*) AS requests
FROM events GROUP BY error"""

# --- decisions ------------------------------------------------------------

SCORED = """
scored AS (
  SELECT user_id % 5 AS fleet, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
         least(value / 200, 1.0) AS prob, CAST(value AS DECIMAL(18,2)) * 12 AS at_stake
  FROM events)"""
CLASSIFIED = """
classified AS (
  SELECT doc_id, quality AS label, (n_chars % 50) / 50.0::DOUBLE AS prob
  FROM labels JOIN documents USING (doc_id))"""


def points(spec: tuple[float, float, int]) -> str:
    return f"points AS (SELECT unnest({grid(spec)}) AS threshold)"


COUNTS = """count(*) FILTER (prob >= threshold AND label = 1) AS tp,
       count(*) FILTER (prob >= threshold AND label = 0) AS fp,
       count(*) FILTER (prob < threshold AND label = 1) AS fn,
       count(*) FILTER (prob < threshold AND label = 0) AS tn"""
FLAT = "tp * 1500 + fp * 300 + fn * 10000"
_sweep = f"""
sweep AS (SELECT threshold, {COUNTS} FROM scored, points GROUP BY threshold)"""
_fleet_sweep = f"""
sweep AS (SELECT fleet, threshold, {COUNTS} FROM scored, points GROUP BY fleet, threshold)"""
SQL["threshold_sweep_flat"] = f"""
WITH {SCORED}, {points(decision.MAINTENANCE_GRID)}, {_sweep}
SELECT *, {FLAT} AS total_cost, (tp + fn) * 10000 - ({FLAT}) AS savings_vs_reactive
FROM sweep"""
SQL["threshold_sweep_by_fleet"] = f"""
WITH {SCORED}, {points(decision.MAINTENANCE_GRID_99)}, {_fleet_sweep}
SELECT *, {FLAT} AS total_cost FROM sweep"""
_missed = "coalesce(sum(at_stake) FILTER (prob < threshold AND label = 1), 0)"
SQL["threshold_sweep_value"] = f"""
WITH {SCORED}, {points(decision.RETENTION_GRID)}
SELECT threshold, {COUNTS}, {dbl(_missed)} AS missed_value,
       {dbl('coalesce(sum(at_stake) FILTER (label = 1), 0)')} AS value_at_stake,
       {dbl(f'count(*) FILTER (prob >= threshold) * 100 + {_missed}')} AS total_cost
FROM scored, points GROUP BY threshold"""
SQL["optimal_threshold"] = f"""
WITH {SCORED}, {points(decision.MAINTENANCE_GRID)}, {_fleet_sweep},
costed AS (SELECT *, {FLAT} AS total_cost FROM sweep)
SELECT * FROM costed
QUALIFY row_number() OVER (PARTITION BY fleet ORDER BY total_cost, threshold) = 1"""
SQL["policy_comparison"] = f"""
WITH {SCORED}, {points(decision.MAINTENANCE_GRID)}, {_sweep},
best AS (SELECT *, {FLAT} AS total_cost FROM sweep ORDER BY total_cost, threshold LIMIT 1),
half AS (SELECT 0.5::DOUBLE AS threshold, {COUNTS}
         FROM scored, (SELECT 0.5::DOUBLE AS threshold)),
rows AS (
  SELECT 1 AS rank, 'Run-To-Failure (Reactive)' AS strategy, -1.0::DOUBLE AS threshold,
         sum(label) AS fn, 0 AS fp, sum(label) * 10000 AS total_cost FROM scored
  UNION ALL SELECT 2, 'Standard Model', threshold, fn, fp, {FLAT} FROM half
  UNION ALL SELECT 3, 'Cost-Optimized Model', threshold, fn, fp, total_cost FROM best)
SELECT {big('rank')} AS rank, strategy, threshold, {big('fn')} AS fn, {big('fp')} AS fp,
       {big('total_cost')} AS total_cost,
       {big('(SELECT total_cost FROM rows WHERE rank = 1) - total_cost')} AS savings_vs_none,
       {big('(SELECT total_cost FROM rows WHERE rank = 2) - total_cost')} AS savings_vs_default
FROM rows"""
_offer = f"count(*) FILTER (prob >= threshold) * 100 + {_missed}"
_value_counts = f"""count(*) FILTER (prob < threshold AND label = 1) AS fn,
         count(*) FILTER (prob >= threshold AND label = 0) AS fp, {_offer} AS total_cost"""
SQL["retention_policies"] = f"""
WITH {SCORED}, {points(decision.RETENTION_GRID)},
best AS (SELECT fleet, threshold, {_value_counts} FROM scored, points GROUP BY fleet, threshold
         QUALIFY row_number() OVER (PARTITION BY fleet ORDER BY total_cost, threshold) = 1),
rows AS (
  SELECT fleet, 1 AS rank, 'No Program' AS strategy, -1.0::DOUBLE AS threshold,
         sum(label) AS fn, 0 AS fp, sum(at_stake) FILTER (label = 1) AS total_cost
  FROM scored GROUP BY fleet
  UNION ALL SELECT fleet, 2, 'Standard Threshold', 0.5, {_value_counts}
  FROM scored, (SELECT 0.5::DOUBLE AS threshold) GROUP BY fleet
  UNION ALL SELECT fleet, 3, 'Optimized Threshold', threshold, fn, fp, total_cost FROM best)
SELECT fleet, {big('r.rank')} AS rank, strategy, {dbl('threshold')} AS threshold,
       {big('fn')} AS fn, {big('fp')} AS fp, {dbl('total_cost')} AS total_cost,
       {dbl('max(total_cost) FILTER (r.rank = 1) OVER (PARTITION BY fleet) - total_cost')}
         AS savings_vs_none,
       {dbl('max(total_cost) FILTER (r.rank = 2) OVER (PARTITION BY fleet) - total_cost')}
         AS savings_vs_default
FROM rows r"""
SQL["classification_metrics"] = f"""
WITH {CLASSIFIED}, c AS (SELECT {COUNTS} FROM classified, (SELECT 0.5::DOUBLE AS threshold))
SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
       CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM c"""


def auc(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
ties AS (SELECT {lead}prob, sum(label) AS pos, count(*) - sum(label) AS neg
         FROM {source} GROUP BY {lead}prob),
ranked AS (SELECT *, sum(neg) OVER ({part} ORDER BY prob) - neg AS below FROM ties)
SELECT {lead}{big('sum(pos)')} AS positives, {big('sum(neg)')} AS negatives,
       {dbl('sum(pos * (2 * below + neg))')} / (2.0::DOUBLE * sum(pos) * sum(neg)) AS auc
FROM ranked {group}"""


SQL["roc_auc"] = f"WITH {CLASSIFIED}, {auc('classified')}"
SQL["roc_auc_by_fleet"] = f"WITH {SCORED}, {auc('scored', 'fleet')}"
SQL["calibration"] = f"""
WITH {SCORED}, p AS (SELECT label, CAST(prob AS DECIMAL(18,6)) AS prob FROM scored)
SELECT {big('floor(prob * 10)')} AS band, count(*) AS n, {big('sum(label)')} AS positives,
       {mean('label')} AS observed_rate, round({mean('prob')}, 9) AS mean_probability
FROM p GROUP BY band"""

# --- subjects -------------------------------------------------------------

_services = ", ".join(
    f"CASE WHEN max(CASE WHEN o_orderpriority = '{text}' THEN 1 ELSE 0 END) = 1 "
    f"THEN 'Yes' ELSE 'No' END AS {name}" for name, text in b.SERVICES.items())
_count = " + ".join(f"CASE WHEN {name} = 'Yes' THEN 1 ELSE 0 END" for name in b.SERVICES)
SUBJECT = f"""
history AS (
  SELECT o_custkey, max(year(o_orderdate) * 12 + month(o_orderdate))
           - min(year(o_orderdate) * 12 + month(o_orderdate)) AS tenure,
         max(o_orderdate) AS last_order, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
         {_services}
  FROM orders GROUP BY o_custkey),
subject AS (
  SELECT c_custkey AS customer, c_mktsegment AS contract, tenure, total,
         {_count} AS num_services, CAST(total AS DOUBLE) / greatest(tenure, 1) AS monthly,
         CASE WHEN last_order < (SELECT max(o_orderdate) FROM orders)
                - INTERVAL {b.CHURN_DAYS} DAY THEN 1 ELSE 0 END AS churned
  FROM customer JOIN history ON c_custkey = o_custkey)"""
SQL["subject_profile"] = f"""
WITH {SUBJECT}
SELECT count(*) AS total_customers, count(*) FILTER (tenure = 0) AS blank_total_charges_rows,
       100.0::DOUBLE * sum(churned) / count(*) AS overall_churn_rate FROM subject"""
SQL["blank_to_zero"] = f"""
WITH {SUBJECT}
SELECT customer, tenure = 0 AS was_blank,
       CASE WHEN tenure = 0 THEN 0 ELSE CAST(total AS DOUBLE) END AS total_charges FROM subject"""
SQL["service_count"] = f"""
WITH {SUBJECT} SELECT customer, {big('num_services')} AS num_services FROM subject"""
_churn = f"{mean('churned')} AS churn_rate, count(*) AS customer_count"
SQL["churn_by_contract"] = f"""
WITH {SUBJECT} SELECT contract AS contract_type, {_churn} FROM subject GROUP BY contract"""
SQL["churn_by_bucket"] = f"""
WITH {SUBJECT},
bucketed AS (SELECT churned, CASE WHEN tenure > -1 AND tenure <= 12 THEN '0-12 mo'
    WHEN tenure <= 24 THEN '13-24 mo' WHEN tenure <= 48 THEN '25-48 mo'
    WHEN tenure <= 100 THEN '49+ mo' END AS tenure_bucket FROM subject)
SELECT tenure_bucket, {_churn} FROM bucketed WHERE tenure_bucket IS NOT NULL
GROUP BY tenure_bucket"""
SQL["segment_by_rule"] = f"""
WITH {SUBJECT},
s AS (SELECT *, CASE WHEN tenure > 40 THEN 2 ELSE 0 END
               + CASE WHEN num_services > 4 THEN 1 ELSE 0 END AS segment FROM subject),
a AS (SELECT segment, count(*) AS customers, round_even(avg(tenure), 2) AS tenure,
             round_even(avg(monthly), 2) AS charge, round_even(avg(churned), 2) AS rate
      FROM s GROUP BY segment)
SELECT {big('segment')} AS segment, customers,
       CASE WHEN rate > 0.35 THEN 'New & At-Risk'
            WHEN tenure > 40 AND charge > 70 THEN 'Loyal High-Value'
            WHEN tenure > 40 THEN 'Loyal Low-Spend' ELSE 'New Low-Engagement' END AS label,
       CASE WHEN rate > 0.30 THEN 'risky' WHEN rate > 0.15 THEN 'mid' ELSE 'safe' END AS risk
FROM a"""
_share = ("CAST('0x' || substr(md5(customer || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE")
SQL["stratified_split"] = f"""
WITH {SUBJECT} SELECT customer, churned, {_share} < 0.25 AS is_test FROM subject"""
SQL["stratified_split_exact"] = f"""
WITH {SUBJECT}
SELECT customer, churned, row_number() OVER (PARTITION BY churned ORDER BY {_share}, customer)
         <= round(0.25 * count(*) OVER (PARTITION BY churned)) AS is_test FROM subject"""

_std = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_std"
                 for c in ("tenure", "num_services", "monthly"))
SQL["standardised_features"] = f"WITH {SUBJECT} SELECT customer, {_std} FROM subject"
SQL["label_codes"] = f"""
WITH {SUBJECT}
SELECT customer, contract, {dbl('dense_rank() OVER (ORDER BY contract) - 1')} AS contract_code,
       {dbl('dense_rank() OVER (ORDER BY svc_low) - 1')} AS svc_low_code
FROM subject JOIN history ON customer = o_custkey"""
SQL["unit_split"] = f"""
SELECT user_id AS unit, CASE WHEN {_share.replace('customer', 'user_id')} < 0.25
         THEN 'held_out' ELSE 'train' END AS side, count(*) AS n
FROM events GROUP BY user_id"""

# --- certificates of the models ---------------------------------------------
# Figures that hold for any right model, taken from the tables alone.

SQL["segment_certificate"] = f"""
WITH {SUBJECT} SELECT count(*) AS customers, CAST(0 AS BIGINT) AS misplaced FROM subject"""
_held_out = """
held_out AS (SELECT churned, CAST(round(0.25 * count(*)) AS BIGINT) AS n FROM subject
             GROUP BY churned),
model AS (SELECT unnest(['logistic_regression', 'random_forest']) AS model)"""
SQL["model_split_counts"] = f"""
WITH {SUBJECT}, {_held_out}
SELECT model, {big('churned')} AS churned, n AS held_out, n AS customers FROM held_out, model"""
SQL["model_auc_agreement"] = f"""
WITH {SUBJECT}, {_held_out}
SELECT model, CAST(sum(n) AS BIGINT) AS ranked, 0.0::DOUBLE AS difference
FROM held_out, model GROUP BY model"""
SQL["forecast_model"] = """
SELECT '1' AS version, CAST(6 AS BIGINT) AS features, CAST(5 AS BIGINT) AS depth,
       0.05::DOUBLE AS rate, CAST(100 AS BIGINT) AS trees, 1.0::DOUBLE AS importance_total
FROM events LIMIT 1"""
_unit_share = _share.replace("customer", "user_id")
SQL["forecast_nodes"] = f"""
SELECT CAST(100 AS BIGINT) AS trees, count(*) AS least_root, count(*) AS largest_root,
       CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS unreached, CAST(0 AS BIGINT) AS too_deep,
       0.0::DOUBLE AS importance_gap
FROM events WHERE {_unit_share} >= 0.25 AND value IS NOT NULL"""
SQL["forecast_validation"] = f"""
WITH sided AS (
  SELECT user_id, CASE WHEN {_unit_share} < 0.25 THEN 'held_out'
                       WHEN {_unit_share.replace('|42', '|43')} < 0.2 THEN 'validation'
                       ELSE 'train' END AS side FROM events)
SELECT side, count(DISTINCT user_id) AS units, count(*) AS cycles,
       CAST(0 AS BIGINT) AS shared_units, CAST(0 AS BIGINT) AS trees_past_best,
       0.0::DOUBLE AS error_gap FROM sided GROUP BY side"""
SQL["kmeans_restarts"] = f"""
WITH {SUBJECT} SELECT count(*) AS customers, CAST(4 AS BIGINT) AS segments,
       CAST(10 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS lower_starts, 0.0::DOUBLE AS cost_gap
FROM subject"""
SQL["customers_by_period"] = """
WITH placed AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year,
                       o_orderpriority AS priority, o_custkey AS customer FROM orders)
SELECT CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(year) = 0 THEN 'year'
            WHEN grouping(priority) = 0 THEN 'priority' ELSE 'all' END AS level,
       coalesce(month, year) AS period, priority, count(*) AS orders,
       count(DISTINCT customer) AS customers, true AS within
FROM placed GROUP BY GROUPING SETS ((month, priority), (year, priority), (priority), ())"""
SQL["forecast_answers"] = """
SELECT count(*) AS cycles, count(DISTINCT user_id) AS batch_units,
       count(DISTINCT user_id) AS stream_units, CAST(0 AS BIGINT) AS different FROM events"""
_outcome = """
WITH request AS (
  SELECT event_id, CASE WHEN event_id % 17 != 0 THEN user_id END AS unit, event_id % 40 AS cycle,
         CASE WHEN event_id % 40 < 1 THEN 'cycle must be 1 or more'
              WHEN event_id % 50 = 0 THEN 's_1 is missing' END AS error FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unit, cycle, error IS NULL
                               ORDER BY event_id DESC) AS newer FROM request),
judged AS (
  SELECT CASE WHEN error IS NOT NULL THEN error
              WHEN unit IS NOT NULL AND newer > 1 THEN 'cycle was sent again'
              ELSE 'answered' END AS outcome FROM ranked)
SELECT outcome, count(*) AS requests, count(*) AS different FROM judged GROUP BY outcome"""
SQL["request_outcomes"] = SQL["request_outcomes_batch"] = _outcome
SQL["rolling_features_gaps"] = """
WITH series AS (
  SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
         CASE WHEN event_id % 11 != 0 AND event_id % 13 != 0 THEN value END AS s_1
  FROM events)
SELECT unit, cycle, round(avg(s_1) OVER (PARTITION BY unit ORDER BY cycle
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS s_1_roll_mean FROM series"""
SQL["roc_auc_gaps"] = """
WITH scored AS (
  SELECT quality AS label, CASE WHEN doc_id % 7 = 0 THEN -1.0::DOUBLE
           WHEN doc_id % 11 != 0 THEN (n_chars % 50) / 50.0::DOUBLE END AS prob
  FROM labels JOIN documents USING (doc_id)), usable AS (
  SELECT * FROM scored WHERE prob IS NOT NULL AND label IS NOT NULL)
SELECT (SELECT count(*) FROM usable WHERE label = 1) AS positives,
       (SELECT count(*) FROM usable WHERE label != 1) AS negatives,
       sum(CASE WHEN p.prob > n.prob THEN 1.0::DOUBLE WHEN p.prob = n.prob THEN 0.5::DOUBLE
                ELSE 0 END) / count(*) AS auc
FROM usable p JOIN usable n ON p.label = 1 AND n.label != 1"""

# --- monitor --------------------------------------------------------------

STATUS_RULE = """
CASE WHEN health < 50 OR temperature > 302 OR torque > 60 THEN 'FAILURE IMMINENT'
     WHEN health < 75 THEN 'WARNING' ELSE 'NORMAL' END"""
SQL["equipment_status"] = f"""
WITH {READING}
SELECT device, {STATUS_RULE} AS status, count(*) AS readings FROM reading GROUP BY ALL"""
SQL["status_alerts"] = f"""
WITH {READING}, s AS (SELECT *, {STATUS_RULE} AS status FROM reading)
SELECT event_id, device, status,
       CASE WHEN status = 'WARNING' THEN 'Maintenance Warning: Equipment degradation observed.'
            ELSE 'ALERT: Sensor anomaly detected! Air Temp: ' || temperature || '°K, Torque: '
                 || torque || 'Nm' END AS message
FROM s WHERE status != 'NORMAL'"""
SQL["equipment_board"] = f"""
WITH {READING}, s AS (SELECT *, {STATUS_RULE} AS status FROM reading),
total AS (SELECT device, count(*) AS steps, count(*) * 1.5::DOUBLE AS tool_wear,
                 count(*) FILTER (status = 'FAILURE IMMINENT') AS failures,
                 count(*) FILTER (status = 'WARNING') AS warnings FROM s GROUP BY device),
hours AS (SELECT device, {mean('temperature')} AS temperature, {mean('torque')} AS torque
          FROM s GROUP BY device, date_trunc('hour', ts)
          QUALIFY row_number() OVER (PARTITION BY device ORDER BY date_trunc('hour', ts) DESC) = 1)
SELECT device, event_id, status, steps, tool_wear, failures, warnings, true AS received,
       round(h.temperature, 6) AS trend_temperature, h.torque AS trend_torque
FROM s JOIN total USING (device) JOIN hours h USING (device)
QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) = 1"""
SQL["buffer_append"] = """
SELECT user_id AS device, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20"""
_stamp = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SQL["tumbling_trend"] = f"""
WITH w AS (SELECT date_trunc('day', ts) AS s, event_type, CAST(value AS DECIMAL(18,2)) AS v
           FROM events)
SELECT {_stamp.format('s')} AS window_start, {_stamp.format('s + INTERVAL 1 DAY')} AS window_end,
       event_type, count(*) AS n, {mean('v')} AS mean_value
FROM w GROUP BY s, event_type"""
SQL["sliding_trend"] = f"""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')
                    - k * INTERVAL 6 HOUR AS s, event_type, CAST(value AS DECIMAL(18,2)) AS v
           FROM events, range(0, 4) r(k))
SELECT {_stamp.format('s')} AS window_start, {_stamp.format('s + INTERVAL 1 DAY')} AS window_end,
       event_type, count(*) AS n, {mean('v')} AS mean_value
FROM w GROUP BY s, event_type"""
SQL["late_ledger"] = f"""
WITH e AS (SELECT event_id % 4 AS batch, ts, event_type, CAST(value AS DECIMAL(18,2)) AS value,
                  date_trunc('day', ts) AS day FROM events),
newest AS (SELECT batch, max(ts) AS ts FROM e GROUP BY batch),
mark AS (SELECT b.batch, max(n.ts) - INTERVAL 10 DAY AS mark
         FROM newest b LEFT JOIN newest n ON n.batch < b.batch GROUP BY b.batch),
j AS (SELECT e.*, mark IS NOT NULL AND ts < mark AS late FROM e JOIN mark USING (batch)),
w AS (SELECT event_type, day, count(*) AS n FROM j WHERE NOT late GROUP BY event_type, day),
c AS (SELECT event_type, {big('sum(n)')} AS counted, count(*) AS windows, max(n) AS most
      FROM w GROUP BY event_type),
l AS (SELECT event_type, count(*) AS late, {dbl('sum(value)')} AS late_value
      FROM j WHERE late GROUP BY event_type)
SELECT event_type, counted, windows, most, late, late_value FROM c FULL JOIN l USING (event_type)"""
SQL["step_counter"] = """
SELECT user_id AS device, count(*) AS steps, count(*) * 1.5::DOUBLE AS tool_wear
FROM events GROUP BY user_id"""
SQL["stream_dedup"] = f"WITH {VISIT} SELECT DISTINCT user_id FROM visit"

# --- sources and report text ----------------------------------------------

SQL["csv_scan"] = f"""
SELECT p_type, count(*) AS parts, count(DISTINCT p_brand) AS brands,
       {dbl('sum(CAST(p_retailprice AS DECIMAL(18,2)))')} AS total_price
FROM part GROUP BY p_type"""
SQL["whitespace_scan"] = f"""
WITH {SERIES}
SELECT unit, count(*) AS n, {dbl('sum(CAST(s_1 AS DECIMAL(18,2)))')} AS s_1, max(s_2) AS s_2
FROM series GROUP BY unit"""
SQL["reviews_scan"] = """
WITH r AS (
  SELECT doc_id % 5 + 1 AS review_score, text,
         CASE WHEN doc_id % 3 <> 0 THEN 'say "' || source || '"' || chr(10) || 'to all' END AS title,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS created, doc_id % 7 <> 0 AS answered
  FROM documents)
SELECT review_score, count(*) AS reviews, count(title) AS titled,
       CAST(sum(length(title)) AS BIGINT) AS title_chars,
       CAST(sum(length(text)) AS BIGINT) AS message_chars,
       CAST(sum(CASE WHEN answered THEN 1 ELSE 0 END) AS BIGINT) AS answered,
       strftime(max(created), '%Y-%m-%d %H:%M:%S') AS newest
FROM r GROUP BY review_score"""
for _name in ("csv_rejects", "whitespace_rejects"):
    SQL[_name] = f"""
WITH j AS (
  SELECT event_id, ts, CAST(value AS DECIMAL(18,2)) AS value,
         CASE WHEN event_id % 17 = 0 THEN 'not 3 fields' WHEN event_id % 13 = 0
              THEN 'ts: not timestamp' WHEN event_id % 11 = 0
              THEN 'value: not decimal(18,2)' ELSE 'loaded' END AS reason
  FROM events)
SELECT reason, count(*) AS records, {big('sum(event_id)')} AS ids,
       strftime(max(CASE WHEN reason = 'loaded' THEN ts END), '%Y-%m-%d %H:%M:%S') AS newest,
       {dbl("sum(CASE WHEN reason = 'loaded' THEN value END)")} AS total
FROM j GROUP BY reason"""
SQL["positional_truth"] = """
WITH lives AS (SELECT user_id AS unit, count(*) AS life FROM events GROUP BY user_id)
SELECT unit, row_number() OVER (ORDER BY unit) AS line, life FROM lives"""
SQL["report_text"] = f"""
SELECT o_orderkey, {dbl('round(CAST(o_totalprice AS DECIMAL(18,2)), 1)')} AS half_up,
       round_even({dbl('round(CAST(o_totalprice AS DECIMAL(18,2)), 1)')}, 0) AS half_even,
       strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
       format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS whole,
       regexp_replace(replace(replace(o_orderpriority, '-', '_'), ' ', '_'), '_', ' ') AS label
FROM orders"""


# --- documents --------------------------------------------------------------

def section(name: str, rows: str, order: str, **fields: str) -> list[str]:
    """The fields of one section, a row each; ``fields`` gives an expression per field, with
    ``text:`` before those that are text."""
    out = []
    for field, value in fields.items():
        is_text = value.startswith("text:")
        value = value.removeprefix("text:")
        number, text = ("CAST(NULL AS DOUBLE)", value) if is_text else (dbl(value),
                                                                        "CAST(NULL AS VARCHAR)")
        out.append(f"""
SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}) AS position,
       '{field}' AS field, {number} AS number, {text} AS text FROM ({rows})""")
    return out


def _to(digits: int, value: str) -> str:
    return f"round({value}, {digits})"


SQL["marketplace_fields"] = " UNION ALL ".join([
    *section("kpis", SQL["kpis"], "1", total_orders="total_orders",
             total_revenue=_to(2, "total_revenue"),
             avg_order_item_value=_to(2, "avg_order_item_value"),
             avg_review_score=_to(2, "avg_review_score")),
    *section("monthly_revenue", SQL["monthly_revenue"], "month", month="text:month",
             revenue=_to(2, "revenue"), orders="orders"),
    *section("delivery_vs_reviews", SQL["delivery_vs_reviews"],
             "round(avg_review_score, 2) DESC, delivery_status", status="text:delivery_status",
             avg_score=_to(2, "avg_review_score"), count="order_count"),
    *section("late_rate_trend", SQL["late_rate_trend"], "month", month="text:month",
             late_pct=_to(2, "late_pct")),
    *section("category_risk", SQL["category_risk"], "round(revenue, 2) DESC, category",
             category="text:category", revenue=_to(2, "revenue"), orders="order_count",
             late_pct=_to(2, "late_pct"), avg_score=_to(2, "avg_review_score")),
    *section("state_performance", SQL["state_performance"], "round(revenue, 2) DESC, state",
             state="text:state", revenue=_to(2, "revenue"), orders="order_count",
             avg_delivery_days=_to(1, "avg_delivery_days"),
             avg_score=_to(2, "avg_review_score")),
    *section("payment_breakdown", SQL["payment_breakdown"],
             "round(total_value, 2) DESC, payment_type", type="text:payment_type",
             count="payments", avg_installments=_to(1, "avg_installments"),
             total_value=_to(2, "total_value"))])


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Scalar column rules. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Status names, limits and label texts of the reports.
NOT_DELIVERED, LATE, ON_TIME = "Not Delivered", "Late", "On Time"
FAILURE_IMMINENT, WARNING, NORMAL = "FAILURE IMMINENT", "WARNING", "NORMAL"
TENURE_EDGES = (-1, 12, 24, 48, 100)
TENURE_LABELS = ("0-12 mo", "13-24 mo", "25-48 mo", "49+ mo")
RUL_CAP = 125
FAILURE_HORIZON = 20
HEALTH_FAILURE, HEALTH_WARNING = 50.0, 75.0
TEMPERATURE_LIMIT, TORQUE_LIMIT = 302.0, 60.0


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- marketplace ---------------------------------------------------------

def delivery_status(delivered: Column | str, estimated: Column | str) -> Column:
    """'Not Delivered', 'Late' or 'On Time'; equal to the estimate is on time."""
    delivered, estimated = _col(delivered), _col(estimated)
    return (F.when(delivered.isNull(), NOT_DELIVERED)
            .when(delivered > estimated, LATE)
            .otherwise(ON_TIME))


def late_flag(delivered: Column | str, estimated: Column | str) -> Column:
    """1 when delivered after the estimate, else 0; an undelivered order is not late."""
    return F.coalesce(_col(delivered) > _col(estimated), F.lit(False)).cast("int")


def first_known(*columns: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(*[_col(c) for c in columns], F.lit(default))


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(_col(end), _col(start))


def share_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; NULL when ``whole`` is zero."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def delivery_risk_tag(days: Column | str, limit: float = 14) -> Column:
    return F.when(_col(days) > limit, "High Delivery Time").otherwise("Healthy")


def risk_tier(rate: Column | str) -> Column:
    rate = _col(rate)
    return F.when(rate > 0.30, "risky").when(rate > 0.15, "mid").otherwise("safe")


# --- subjects ------------------------------------------------------------

def yes_flag(value: Column | str, yes: str = "Yes") -> Column:
    """1 for the 'yes' text, 0 for everything else including NULL."""
    return F.coalesce(_col(value) == yes, F.lit(False)).cast("int")


def count_yes(columns: Sequence[str], yes: str = "Yes") -> Column:
    """How many of the columns hold the 'yes' text."""
    return reduce(lambda a, b: a + b, [yes_flag(c, yes) for c in columns])


def is_blank(text: Column | str) -> Column:
    return F.trim(_col(text)) == ""


def blank_to_zero(text: Column | str, to: str = "double") -> Column:
    """Numeric text with blanks read as zero; NULL stays NULL."""
    text = _col(text)
    return F.when(is_blank(text), F.lit(0).cast(to)).otherwise(F.trim(text).cast(to))


def bin_right_closed(value: Column | str, edges: Sequence[float],
                     labels: Sequence[str]) -> Column:
    """Label of the interval (low, high] holding the value; NULL outside all of them."""
    value = _col(value)
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def bin_ordinal(label: Column | str, labels: Sequence[str]) -> Column:
    """Position of a bin label, for sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), _col(label)).cast("int")


def segment_label(churn_rate: Column | str, tenure: Column | str,
                  charge: Column | str) -> Column:
    """Name of a customer segment, from its averages rounded to two digits."""
    # The limits and names of the reports.
    churn_rate, tenure, charge = _col(churn_rate), _col(tenure), _col(charge)
    return (F.when(churn_rate > 0.35, "New & At-Risk")
            .when((tenure > 40) & (charge > 70), "Loyal High-Value")
            .when(tenure > 40, "Loyal Low-Spend")
            .otherwise("New Low-Engagement"))


# --- equipment -----------------------------------------------------------

def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value on either side; NULL stays NULL."""
    value = _col(value)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def failure_probability(predicted: Column | str, cap: float = RUL_CAP) -> Column:
    """1 - predicted/cap, with the quotient held inside [0, 1]."""
    return F.lit(1.0) - clip(_col(predicted).cast("double") / F.lit(float(cap)), 0.0, 1.0)


def fails_soon(rul: Column | str, horizon: float = FAILURE_HORIZON) -> Column:
    return (_col(rul) <= horizon).cast("int")


def equipment_status(health: Column | str, temperature: Column | str, torque: Column | str,
                     *, temperature_limit: Column | float = TEMPERATURE_LIMIT,
                     torque_limit: Column | float = TORQUE_LIMIT) -> Column:
    """Status of one reading. Limits are strict: a value on the limit is no alert."""
    health = _col(health)
    return (F.when((health < HEALTH_FAILURE) | (_col(temperature) > temperature_limit)
                   | (_col(torque) > torque_limit), FAILURE_IMMINENT)
            .when(health < HEALTH_WARNING, WARNING)
            .otherwise(NORMAL))


def alert_text(status: Column | str, temperature: Column | str, torque: Column | str) -> Column:
    """Message for a reading that needs attention; NULL for a normal one."""
    # The texts of the monitor.
    status = _col(status)
    return (F.when(status == FAILURE_IMMINENT,
                   F.concat(F.lit("ALERT: Sensor anomaly detected! Air Temp: "),
                            _col(temperature).cast("string"), F.lit("°K, Torque: "),
                            _col(torque).cast("string"), F.lit("Nm")))
            .when(status == WARNING,
                  "Maintenance Warning: Equipment degradation observed."))


# --- grids and texts -----------------------------------------------------

def linspace(start: float, stop: float, points: int) -> list[float]:
    """Evenly spaced doubles, computed once so that every engine compares the same values."""
    step = (stop - start) / (points - 1)
    return [start + i * step for i in range(points - 1)] + [stop]


def double_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def whole_text(value: Column | str) -> Column:
    """Thousands-separated whole number, for report text."""
    return F.format_number(_col(value), 0)


def fixed_text(value: Column | str, digits: int) -> Column:
    """Fixed number of decimals without separators, for report text."""
    return F.format_string(f"%.{digits}f", _col(value).cast("double"))


def display_label(value: Column | str) -> Column:
    """First underscore shown as a blank."""
    return F.regexp_replace(_col(value), "^([^_]*)_", "$1 ")

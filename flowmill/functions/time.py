"""Time expressions over epoch or timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.1415926535  # fixed value: the model features are defined with this many digits

_TO_TIMESTAMP = {
    "s": F.timestamp_seconds,
    "ms": F.timestamp_millis,
    "us": F.timestamp_micros,
    "ns": lambda c: F.timestamp_micros(F.call_function("div", c, F.lit(1000))),
    "timestamp": lambda c: c.cast("timestamp"),
}


def to_timestamp(column: Column | str, unit: str = "s") -> Column:
    """Instant of an epoch count in ``unit``; ``timestamp`` takes timestamp columns as they are."""
    if unit not in _TO_TIMESTAMP:
        raise ValueError(f"unit must be one of {sorted(_TO_TIMESTAMP)}, got {unit!r}")
    return _TO_TIMESTAMP[unit](F.col(column) if isinstance(column, str) else column)


def epoch_seconds(instant: Column) -> Column:
    return F.unix_timestamp(instant)


def day_of_week(instant: Column) -> Column:
    """Sunday is 0, Saturday is 6."""
    return (F.dayofweek(instant) - 1).cast("int")


def weekend_flag(day: Column, weekend_days: tuple[int, ...] = (5, 6)) -> Column:
    """1 on the given days. The default marks Friday and Saturday; ``(0, 6)`` is Saturday-Sunday."""
    return F.when(day.isin(*weekend_days), 1).otherwise(0)


def cyclic(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour on a 24-hour circle."""
    angle = hour * F.lit(2 * PI) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def iso_seconds(instant: Column) -> Column:
    """ISO-8601 text, cut to the second."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")

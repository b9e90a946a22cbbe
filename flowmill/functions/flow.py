"""Expressions over the raw flow columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.functions import time
from flowmill.sources.schemas import WELL_KNOWN_PORTS


TIME_FEATURES = ("hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos")


def time_columns(
    column: str = "timestamp", unit: str = "s", weekend_days: tuple[int, ...] = (5, 6)
) -> dict[str, Column]:
    instant = time.to_timestamp(column, unit)
    hour, day = F.hour(instant), time.day_of_week(instant)
    hour_sin, hour_cos = time.cyclic(hour)
    return {
        "timestamp_ts": instant,
        "hour": hour,
        "dayofweek": day,
        "is_weekend": time.weekend_flag(day, weekend_days),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
    }


def log_columns() -> dict[str, Column]:
    return {
        "bytes_log": F.log1p("bytes_transferred"),
        "packet_log": F.log1p("packet_count"),
    }


def protocol_conn() -> Column:
    """Protocol and state joined by ``_``; a null part is left out."""
    return F.concat_ws("_", "protocol", "conn_state")


def session_key(separator: str = "_") -> Column:
    """Text form of the session. Windows use the three columns themselves."""
    return F.concat_ws(
        separator, F.col("src_port").cast("string"), F.col("dst_port").cast("string"), "protocol"
    )


def bytes_per_packet() -> Column:
    return F.try_divide(F.col("bytes_transferred"), F.col("packet_count") + 1)


def packets_per_byte() -> Column:
    return F.try_divide(F.col("packet_count"), F.col("bytes_transferred") + F.lit(1.0))


def well_known_flag(column: str = "dst_port") -> Column:
    return F.when(F.col(column).isin(*WELL_KNOWN_PORTS), 1).otherwise(0)


def port_bucket(column: str = "src_port", width: int = 10_000) -> Column:
    """Whole multiples of ``width``, cut towards zero."""
    return (F.col(column) / width).cast("int")

"""Schemas, domains and column lists shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: domains, column names, their types and their order are a contract
PROTOCOLS = ("TCP", "UDP", "ICMP")
CONN_STATES = ("EST", "SYN", "FIN", "RST")
CLASS_NAMES = ("Normal", "DoS", "Probe", "R2L", "U2R", "Worm")
CLASS_WEIGHTS = (0.942, 0.02, 0.01, 0.015, 0.008, 0.005)
NUM_CLASSES = 6
PORT_MAX, PACKETS_MAX, BYTES_MAX = 65535.0, 2000.0, 2e6
WELL_KNOWN_PORTS = (21, 22, 23, 25, 53, 80, 110, 143, 443)
PROBE_PORTS = (21, 22, 23, 80, 443)
SPLITS = ("train", "val", "test")
TARGET = "attack"
SESSION_KEYS = ("src_port", "dst_port", "protocol")

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("conn_state", T.StringType()),
        T.StructField("bytes_transferred", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("attack", T.LongType()),
    ]
)

PROPERTIES = FLOW_SCHEMA.fieldNames()[:6]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("properties", T.StructType([FLOW_SCHEMA[c] for c in PROPERTIES])),
        T.StructField("label", T.LongType()),
    ]
)

#: What a message is, wherever it comes from.
MESSAGE_SCHEMA = "key string, value string, partition int, offset long, message_time timestamp"

CATEGORICAL = ("protocol", "conn_state", "protocol_conn")
NUMERIC = (
    "src_port", "dst_port", "packet_count", "bytes_transferred", "bytes_log", "packet_log",
    "hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos",
)
FEATURES = tuple(f"{c}_idx" for c in CATEGORICAL) + tuple(f"{c}_norm" for c in NUMERIC)

# Columns of the extended set (time, flags, ratios, indexes, previous-event windows).
EXTENDED_FEATURES = (
    "src_port", "dst_port", "packet_count", "bytes_transferred", "bytes_log", "packet_log",
    "pkt_per_byte", "hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos",
    "dst_well_known", "src_port_bucket", "protocol_idx", "conn_state_idx", "protocol_conn_idx",
    "prev_bytes_mean_3", "prev_packet_mean_3", "prev_event_count_3",
)

# Columns of the session set (ratios, previous-event windows, whole-session statistics).
SESSION_FEATURES = (
    "src_port", "dst_port", "packet_count", "bytes_transferred", "bytes_log", "packet_log",
    "bytes_per_packet", "bytes_per_packet_log",
    "prev_bytes_mean_3", "prev_packet_mean_3", "prev_event_count_3",
    "session_bytes_max", "session_bytes_min", "session_packet_mean",
    "protocol_idx", "conn_state_idx", "timestamp_epoch",
)
# ---------------------------------------------------------------------------

"""The ``traffic`` flow table derived from ``events``, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import messages
from flowmill.operators.labelling import with_label
from flowmill.sources.session import configure

FLOW_COLUMNS = (
    "src_port", "dst_port", "protocol", "packet_count", "conn_state", "bytes_transferred",
    "timestamp", "attack",
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    return events(spark, sf_dir).select(
        "event_id",
        (1024 + (F.col("user_id") * 7919) % 64511).alias("src_port"),
        F.when(e % 10 == 0, 22).when(e % 10 == 1, 80).when(e % 10 == 2, 443)
        .otherwise(5000 + e % 3).cast("long").alias("dst_port"),
        F.when(kind.isin("click", "view"), "TCP").when(kind.isin("purchase", "signup"), "UDP")
        .otherwise("ICMP").alias("protocol"),
        (1 + F.floor(v * 6)).cast("long").alias("packet_count"),
        F.when(e % 4 == 0, "EST").when(e % 4 == 1, "SYN").when(e % 4 == 2, "FIN")
        .otherwise("RST").alias("conn_state"),
        (v * 6000).alias("bytes_transferred"),
        F.unix_timestamp("ts").alias("timestamp"),
        (e % 6).alias("attack"),
        (F.floor(e / 10) % 10).cast("long").alias("bucket"),
    )


TRAFFIC = """traffic AS (
  SELECT event_id,
    1024 + (user_id * 7919) % 64511 AS src_port,
    CAST(CASE event_id % 10 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443
         ELSE 5000 + event_id % 3 END AS BIGINT) AS dst_port,
    CASE WHEN event_type IN ('click', 'view') THEN 'TCP'
         WHEN event_type IN ('purchase', 'signup') THEN 'UDP' ELSE 'ICMP' END AS protocol,
    CAST(1 + floor(value * 6) AS BIGINT) AS packet_count,
    CASE event_id % 4 WHEN 0 THEN 'EST' WHEN 1 THEN 'SYN' WHEN 2 THEN 'FIN' ELSE 'RST' END AS conn_state,
    value * 6000 AS bytes_transferred,
    CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
    event_id % 6 AS attack,
    CAST(floor(event_id / 10) AS BIGINT) % 10 AS bucket
  FROM events)"""


def split(df: DataFrame, name: str) -> DataFrame:
    bucket = F.col("bucket")
    condition = {"train": bucket < 6, "val": bucket.isin(6, 7), "test": bucket >= 8}[name]
    return df.filter(condition)


SPLIT_SQL = "CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 THEN 'val' ELSE 'test' END"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traffic`` with ``label`` (its class) and ``prediction`` (the concept rule)."""
    return with_label(traffic(spark, sf_dir).withColumn("label", F.col("attack")), "concept", "prediction")


UNITS = """units AS (
  SELECT *, packet_count / 2000.0::DOUBLE AS pc, bytes_transferred / 2e6::DOUBLE AS bt,
    src_port / 65535.0::DOUBLE AS sp, dst_port / 65535.0::DOUBLE AS dp,
    CASE protocol WHEN 'TCP' THEN -1.0::DOUBLE WHEN 'UDP' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS proto,
    CASE conn_state WHEN 'EST' THEN -1.0::DOUBLE WHEN 'SYN' THEN -1.0::DOUBLE + 2.0::DOUBLE / 3
         WHEN 'FIN' THEN -1.0::DOUBLE + 2 * (2.0::DOUBLE / 3) ELSE 1.0::DOUBLE END AS state,
    CASE WHEN dst_port IN (21, 22, 23, 80, 443) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS probe,
    CASE WHEN protocol = 'ICMP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS icmp
  FROM traffic)"""

CONCEPT = """concept AS (
  SELECT *, [
    0.8::DOUBLE - 0.2::DOUBLE * (abs(pc - 0.35::DOUBLE) + abs(bt - 0.35::DOUBLE)),
    4.0::DOUBLE * bt + 0.8::DOUBLE * icmp - 0.3::DOUBLE * pc,
    CASE WHEN (src_port % 1000) / 1000.0::DOUBLE < 0.2::DOUBLE THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + probe,
    2.0::DOUBLE * icmp + CASE WHEN bt > 0.05::DOUBLE AND bt < 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
    CASE WHEN pc > 0.7::DOUBLE THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + 1.2::DOUBLE * bt,
    1.5::DOUBLE * sp * dp + CASE WHEN pc > 0.2::DOUBLE AND pc < 0.6::DOUBLE THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
  ] AS scores FROM units)"""

NORMAL = """normal AS (
  SELECT *, [
    1.0::DOUBLE - abs(pc - 0.3::DOUBLE) - abs(bt - 0.3::DOUBLE) + 0.2::DOUBLE * (1 - abs(proto))
      + 0.1::DOUBLE * (1 - abs(state)),
    3.0::DOUBLE * pc * pc + 1.5::DOUBLE / (1.0::DOUBLE + exp(-(proto - 0.5::DOUBLE)))
      + 0.5::DOUBLE * (1 - sp) + 0.3::DOUBLE * pc * proto,
    1.5::DOUBLE * probe + 2.0::DOUBLE * pc * (1 - pc) + 0.5::DOUBLE * dp * pc + 0.3::DOUBLE * dp * state,
    2.0::DOUBLE * state * (1 - bt) + 0.5::DOUBLE * (1 - dp) + 0.3::DOUBLE * bt * state + state * (1 - pc),
    1.5::DOUBLE * bt * bt + 0.5::DOUBLE * state * sp + 0.3::DOUBLE * bt * pc + 0.5::DOUBLE * sp * (1 - dp),
    2.0::DOUBLE * bt * pc + 0.5::DOUBLE * (1 - icmp) + 0.3::DOUBLE * sp * dp
  ] AS scores FROM units)"""

ARGMAX = "CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT)"

PREDICTIONS = f"""{TRAFFIC}, {UNITS}, {CONCEPT},
predictions AS (SELECT *, attack AS label, {ARGMAX} AS prediction FROM concept)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scoring request per flow; every eighth kind is broken in its own way, and one kind brings
    its time features along instead of a time."""
    kind = F.col("event_id") % 8
    brought = {"hour": F.col("event_id") % 24, "dayofweek": F.lit(4), "is_weekend": F.lit(0), "hour_sin": F.lit(0.5),
               "hour_cos": F.lit(-0.25)}
    row = F.to_json(F.struct(
        *FLOW_COLUMNS[:-2], F.when(kind != 7, F.col("timestamp")).alias("timestamp"),
        *[F.when(kind == 7, v).alias(k) for k, v in brought.items()],
    ))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"data": ['), row, F.lit(", "), row, F.lit("]}")))
        .when(kind == 1, F.lit("[]"))
        .when(kind == 2, F.lit('{"x": 1}'))
        .when(kind == 3, F.lit('{"data": 5}'))
        .when(kind == 4, F.lit("not json"))
        .when(kind == 5, F.lit('{"data": []}'))
        .otherwise(F.concat(F.lit('{"data": '), row, F.lit("}")))
    )
    return traffic(spark, sf_dir).select(F.col("event_id").alias("request_id"), body.alias("body"))


def event_messages(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Flows as topic messages; with ``broken`` each tenth kind of record is unusable."""
    flows = traffic(spark, sf_dir)
    text = messages.encode_event(F.col("event_id"))
    if broken:
        kind = F.col("event_id") % 10
        text = (
            F.when(kind == 0, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
            .when(kind == 1, F.lit("{}"))
            .when(kind == 2, F.lit('{"data": 5}'))
            .when(kind == 3, F.lit("[1]"))
            .otherwise(text)
        )
    return flows.select(
        F.col("event_id").cast("string").alias("key"), text.alias("value"),
        (F.col("event_id") % 6).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 6).cast("long").alias("offset"), F.timestamp_seconds("timestamp").alias("message_time"),
    )

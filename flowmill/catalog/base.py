"""Scans, projections, scalar expressions, encoders, scalers and feature sets."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowmill.catalog.fixture import (
    ARGMAX, CONCEPT, FLOW_COLUMNS, SPLIT_SQL, TRAFFIC, UNITS, events, split, traffic,
)
from flowmill.catalog.registry import query, r, rounded
from flowmill.functions import flow, scalar, scores, time
from flowmill.functions.messages import new_event_id
from flowmill.operators import encode as enc
from flowmill.operators import labelling, sessions
from flowmill.operators import scale as sc
from flowmill.plans import features as plan
from flowmill.plans import splits as job
from flowmill.sources import parquet
from flowmill.sources import params as stored
from flowmill.sources import schemas as S
from flowmill.sources.session import configure, new_dir

FLOW_SQL = 'src_port, dst_port, protocol, packet_count, conn_state, bytes_transferred, "timestamp", attack'

BASE = """base AS (
  SELECT *, CAST(hour(moment) AS INTEGER) AS hour, CAST(dayofweek(moment) AS INTEGER) AS dayofweek,
    CASE WHEN dayofweek(moment) IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
    sin(hour(moment) * 6.283185307::DOUBLE / 24.0::DOUBLE) AS hour_sin,
    cos(hour(moment) * 6.283185307::DOUBLE / 24.0::DOUBLE) AS hour_cos,
    ln(1 + bytes_transferred) AS bytes_log, ln(1.0::DOUBLE + packet_count) AS packet_log,
    concat_ws('_', protocol, conn_state) AS protocol_conn
  FROM (SELECT *, make_timestamp("timestamp" * 1000000) AS moment FROM traffic))"""


def _index(column: str, where: str = "true", order: str = "v") -> str:
    """Encoder of one column as a table ``enc_<column>(v, idx)``."""
    return f"""enc_{column} AS (
  SELECT v, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS idx
  FROM (SELECT {column} AS v, count(*) AS n FROM base WHERE {where} AND {column} IS NOT NULL GROUP BY 1))"""


def _indexed(column: str) -> str:
    return f"coalesce((SELECT idx FROM enc_{column} WHERE v = {column}), -1) AS {column}_idx"


def _encoders(where: str = "true", order: str = "v", columns: tuple[str, ...] = S.CATEGORICAL) -> str:
    return ", ".join(_index(c, where, order) for c in columns)


def _stats(table: str, columns: tuple[str, ...], where: str = "true", fn: str = "stddev_samp") -> str:
    parts = ", ".join(
        f"avg({c}) AS m_{c}, coalesce(nullif({fn}({c}), 0), 1.0::DOUBLE) AS s_{c}" for c in columns
    )
    return f"stats AS (SELECT {parts} FROM {table} WHERE {where})"


def _scaled(columns: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(r(f"({c} - m_{c}) / s_{c}", f"{c}_norm", digits) for c in columns)


def _final(digits: int) -> str:
    return f"""{TRAFFIC}, {BASE}, {_encoders('bucket < 6')}, {_stats('base', S.NUMERIC, 'bucket < 6')},
final AS (SELECT event_id, bucket, {', '.join(_indexed(c) for c in S.CATEGORICAL)}, {_scaled(S.NUMERIC, digits)}, attack
  FROM base, stats)"""


FINAL = _final(6)
UNROUNDED = _final(15)
FINAL_COLUMNS = ", ".join(["event_id", *S.FEATURES, "attack"])


def fitted_base(spark, sf_dir) -> plan.Fitted:
    return plan.fit_base(split(traffic(spark, sf_dir), "train"))


# ---- scans and sinks --------------------------------------------------------

@query("scan_schema", "SELECT event_id, user_id, event_type, value, CAST(NULL AS BIGINT) AS attack FROM events")
def scan_schema(spark, sf_dir):
    schema = "event_id long, user_id long, event_type string, value double, attack long"
    return parquet.scan(configure(spark), f"{sf_dir}/events.parquet", schema)


def _raw_splits(spark, sf_dir) -> str:
    """Raw flows written as one directory per split."""
    root = new_dir(spark, "raw")
    flows = traffic(spark, sf_dir)
    for name in S.SPLITS:
        parquet.write(split(flows, name).select(*FLOW_COLUMNS), parquet.split_path(root, name))
    return root


@query("scan_split", f"WITH {TRAFFIC} SELECT {FLOW_SQL} FROM traffic WHERE bucket IN (6, 7)")
def scan_split(spark, sf_dir):
    return parquet.scan_split(spark, _raw_splits(spark, sf_dir), "val")


@query("scan_parallelism", "SELECT event_id, user_id, value FROM events")
def scan_parallelism(spark, sf_dir):
    schema = "event_id long, user_id long, value double"
    return parquet.scan_partitions(configure(spark), f"{sf_dir}/events.parquet", 16, schema)


@query("sink_max_records", f"WITH {TRAFFIC} SELECT event_id, {FLOW_SQL} FROM traffic")
def sink_max_records(spark, sf_dir):
    path = new_dir(spark, "flows")
    parquet.write(traffic(spark, sf_dir).select("event_id", *FLOW_COLUMNS), path, 1000)
    return parquet.scan(spark, path, schema=None)


@query("shape", "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events")
def shape(spark, sf_dir):
    return parquet.row_and_column_count(events(spark, sf_dir))


@query("head", f"WITH {TRAFFIC} SELECT event_id, {FLOW_SQL} FROM traffic ORDER BY event_id LIMIT 6")
def head(spark, sf_dir):
    return traffic(spark, sf_dir).select("event_id", *FLOW_COLUMNS).orderBy("event_id").limit(6)


_ARTIFACT_SQL = " UNION ALL ".join(
    [f"SELECT 'encoder' AS kind, '{c}' AS \"column\", v AS key, {r('CAST(idx AS DOUBLE)', 'value')} FROM enc_{c}"
     for c in S.CATEGORICAL]
    + [f"SELECT 'scaler', '{c}', '{k}', {r(f'{k[0]}_{c}', 'value')} FROM stats" for c in S.NUMERIC for k in ("mean", "std")]
)


@query("artifact_roundtrip",
       f"WITH {TRAFFIC}, {BASE}, {_encoders('bucket < 6')}, {_stats('base', S.NUMERIC, 'bucket < 6')} {_ARTIFACT_SQL}")
def artifact_roundtrip(spark, sf_dir):
    path = new_dir(spark, "params")
    fitted_base(spark, sf_dir).save(spark, path)
    return rounded(stored.as_table(spark, stored.load(spark, path, refresh=True)))


# ---- projections and scalar expressions --------------------------------------

@query("features_time", f"""WITH {TRAFFIC}, {BASE}
SELECT event_id, "timestamp" AS epoch, hour, dayofweek, is_weekend, {r('hour_sin')}, {r('hour_cos')},
  CASE WHEN dayofweek IN (0, 6) THEN 1 ELSE 0 END AS calendar_weekend,
  hour AS hour_ms, hour AS hour_us, hour AS hour_ns, strftime(moment, '%Y-%m-%dT%H:%M:%S') AS iso
FROM base""")
def features_time(spark, sf_dir):
    df = traffic(spark, sf_dir).withColumns(flow.time_columns())
    t = F.col("timestamp")
    return rounded(df.select(
        "event_id", time.epoch_seconds(F.col("timestamp_ts")).alias("epoch"),
        "hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos",
        time.weekend_flag(F.col("dayofweek"), (0, 6)).alias("calendar_weekend"),
        F.hour(time.to_timestamp(t * 1000, "ms")).alias("hour_ms"),
        F.hour(time.to_timestamp(t * 1_000_000, "us")).alias("hour_us"),
        F.hour(time.to_timestamp(t * 1_000_000_000, "ns")).alias("hour_ns"),
        time.iso_seconds(F.col("timestamp_ts")).alias("iso"),
    ))


@query("features_base", f"""WITH {TRAFFIC}, {BASE}
SELECT event_id, hour, dayofweek, is_weekend, {r('hour_sin')}, {r('hour_cos')}, {r('bytes_log')},
  {r('packet_log')}, protocol_conn FROM base""")
def features_base(spark, sf_dir):
    return rounded(plan.base_columns(traffic(spark, sf_dir)).select(
        "event_id", "hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos", "bytes_log",
        "packet_log", "protocol_conn",
    ))


@query("features_ratio", f"""WITH {TRAFFIC}
SELECT event_id, {r('bytes_transferred / (packet_count + 1)', 'bytes_per_packet')},
  {r('ln(1 + bytes_transferred / (packet_count + 1))', 'bytes_per_packet_log')},
  {r('packet_count / (bytes_transferred + 1.0::DOUBLE)', 'pkt_per_byte')} FROM traffic""")
def features_ratio(spark, sf_dir):
    return rounded(traffic(spark, sf_dir).select(
        "event_id", flow.bytes_per_packet().alias("bytes_per_packet"),
        F.log1p(flow.bytes_per_packet()).alias("bytes_per_packet_log"),
        flow.packets_per_byte().alias("pkt_per_byte"),
    ))


@query("features_ext", f"""WITH {TRAFFIC}
SELECT event_id, CASE WHEN dst_port IN (21, 22, 23, 25, 53, 80, 110, 143, 443) THEN 1 ELSE 0 END AS dst_well_known,
  CAST(trunc(src_port / 10000.0::DOUBLE) AS INTEGER) AS src_port_bucket FROM traffic""")
def features_ext(spark, sf_dir):
    return traffic(spark, sf_dir).select(
        "event_id", flow.well_known_flag().alias("dst_well_known"), flow.port_bucket().alias("src_port_bucket"),
    )


@query("session_key", f"""WITH {TRAFFIC}
SELECT event_id, concat_ws('_', src_port, dst_port, protocol) AS session_id,
  concat_ws('-', src_port, dst_port, protocol) AS session_id_dash FROM traffic""")
def session_key(spark, sf_dir):
    return traffic(spark, sf_dir).select(
        "event_id", flow.session_key().alias("session_id"), flow.session_key("-").alias("session_id_dash"),
    )


@query("cat_to_unit", f"WITH {TRAFFIC}, {UNITS} SELECT event_id, {r('proto')}, {r('state')} FROM units")
def cat_to_unit(spark, sf_dir):
    return rounded(traffic(spark, sf_dir).select(
        "event_id", scalar.spread_category("protocol", S.PROTOCOLS).alias("proto"),
        scalar.spread_category("conn_state", S.CONN_STATES).alias("state"),
    ))


@query("clip", f"""WITH {TRAFFIC} SELECT event_id, least(greatest(packet_count, 1), 2000) AS packet_count,
  least(greatest(bytes_transferred, 0.0::DOUBLE), 2e6::DOUBLE) AS bytes_transferred FROM traffic""")
def clip(spark, sf_dir):
    return labelling.clip_ranges(traffic(spark, sf_dir)).select("event_id", "packet_count", "bytes_transferred")


@query("softmax", f"""WITH {TRAFFIC}, {UNITS}, {CONCEPT},
powers AS (SELECT event_id, list_transform(scores, lambda x: exp(x - list_max(scores))) AS p FROM concept)
SELECT event_id, {', '.join(r(f'p[{k + 1}] / list_sum(p)', f'p{k}') for k in range(6))} FROM powers""")
def softmax(spark, sf_dir):
    scored = traffic(spark, sf_dir).select("event_id", F.array(*scores.concept_scores()).alias("scores"))
    df = scalar.with_softmax(scored, "scores", "p")
    return rounded(df.select("event_id", *[F.col("p")[k].alias(f"p{k}") for k in range(6)]))


@query("argmax", f"""WITH {TRAFFIC}, tied AS (SELECT event_id,
  [(event_id % 3)::DOUBLE, (event_id % 5)::DOUBLE, (event_id % 2)::DOUBLE * 2] AS scores FROM traffic)
SELECT event_id, {ARGMAX} AS class_id FROM tied""")
def argmax(spark, sf_dir):
    e = F.col("event_id")
    tied = F.array((e % 3).cast("double"), (e % 5).cast("double"), (e % 2).cast("double") * 2)
    return traffic(spark, sf_dir).select("event_id", scalar.argmax(tied).alias("class_id"))


@query("binary_threshold", """SELECT event_id,
  CASE WHEN 1 / (1 + exp(-(value - 50.0::DOUBLE) / 10)) > 0.5 THEN 1::BIGINT ELSE 0::BIGINT END AS class_id FROM events""")
def binary_threshold(spark, sf_dir):
    p = scalar.sigmoid((F.col("value") - 50.0) / 10)
    return events(spark, sf_dir).select("event_id", scalar.above_half(p).alias("class_id"))


@query("drop_target", f"""WITH {FINAL} SELECT {SPLIT_SQL} AS split, {', '.join(S.FEATURES)} FROM final""")
def drop_target(spark, sf_dir):
    flows = traffic(spark, sf_dir).withColumn("split", job.split_of())
    return rounded(plan.apply_base(flows, fitted_base(spark, sf_dir), keep=("split",)).drop(S.TARGET))


@query("feature_order", f"""WITH {FINAL} SELECT {', '.join(sorted(S.FEATURES))}, {SPLIT_SQL} AS split FROM final""")
def feature_order(spark, sf_dir):
    flows = traffic(spark, sf_dir).withColumn("split", job.split_of())
    out = plan.apply_base(flows, fitted_base(spark, sf_dir), keep=("split",))
    return rounded(out.select(*sorted(c for c in out.columns if c not in (S.TARGET, "split")), "split"))


_RAW = ("src_port", "dst_port", "packet_count", "bytes_transferred")


@query("assemble", f"WITH {TRAFFIC} " + " UNION ALL ".join(
    f"SELECT event_id, {i} AS pos, {r(f'CAST({c} AS DOUBLE)', 'value')} FROM traffic" for i, c in enumerate(_RAW)))
def assemble(spark, sf_dir):
    vectors = sc.assemble(traffic(spark, sf_dir), _RAW)
    return rounded(vectors.select("event_id", F.posexplode(vector_to_array("features")).alias("pos", "value")))


@query("label_names", f"""WITH {TRAFFIC} SELECT event_id, attack,
  ['Normal', 'DoS', 'Probe', 'R2L', 'U2R', 'Worm'][attack + 1] AS class_name, attack AS class_id FROM traffic""")
def label_names(spark, sf_dir):
    named = labelling.with_class_name(traffic(spark, sf_dir).select("event_id", "attack"))
    return labelling.with_class_id(named)


# ---- encoders and scalers -----------------------------------------------------

@query("vocab", f"WITH {TRAFFIC}, {BASE} SELECT DISTINCT protocol_conn FROM base ORDER BY protocol_conn")
def vocab(spark, sf_dir):
    return plan.base_columns(traffic(spark, sf_dir)).select("protocol_conn").distinct().orderBy("protocol_conn")


def _encoder_rows(order: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", v AS value, n, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS idx "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM base WHERE bucket < 6 GROUP BY 1)" for c in S.CATEGORICAL
    )


@query("fit_encoder", f"WITH {TRAFFIC}, {BASE} {_encoder_rows('v')}")
def fit_encoder(spark, sf_dir):
    return enc.fit_encoder(plan.base_columns(split(traffic(spark, sf_dir), "train")), S.CATEGORICAL)


@query("fit_encoder_freq", f"WITH {TRAFFIC}, {BASE} {_encoder_rows('n DESC, v')}")
def fit_encoder_freq(spark, sf_dir):
    return enc.fit_encoder(plan.base_columns(split(traffic(spark, sf_dir), "train")), S.CATEGORICAL, by="frequency")


@query("encode_join", f"""WITH {TRAFFIC}, {BASE}, {_encoders("protocol <> 'ICMP'")}
SELECT event_id, {', '.join(_indexed(c) for c in S.CATEGORICAL)} FROM base""")
def encode_join(spark, sf_dir):
    df = plan.base_columns(traffic(spark, sf_dir))
    encoders = enc.fit_encoder(df.filter("protocol <> 'ICMP'"), S.CATEGORICAL)  # ICMP stays unseen
    return enc.encode(df, encoders, S.CATEGORICAL).select("event_id", *[f"{c}_idx" for c in S.CATEGORICAL])


def _scaler_rows(columns, digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'm_{c}', 'mean', digits)}, {r(f's_{c}', 'std', digits)} FROM stats" for c in columns
    )


@query("fit_scaler", f"WITH {TRAFFIC}, {BASE}, {_stats('base', S.NUMERIC, 'bucket < 6')} {_scaler_rows(S.NUMERIC)}")
def fit_scaler(spark, sf_dir):
    return rounded(sc.scaler_table(plan.base_columns(split(traffic(spark, sf_dir), "train")), S.NUMERIC))


_POP = ("src_port", "dst_port", "packet_count", "bytes_transferred", "bytes_log", "packet_log")


@query("fit_scaler_pop",
       f"WITH {TRAFFIC}, {BASE}, {_stats('base', _POP, 'bucket < 6', 'stddev_pop')} {_scaler_rows(_POP)}")
def fit_scaler_pop(spark, sf_dir):
    df = plan.base_columns(split(traffic(spark, sf_dir), "train"))
    return rounded(sc.scaler_table(df, _POP, population=True, nulls_as_zero=True))



@query("scale", f"""WITH {TRAFFIC}, {BASE}, {_stats('base', S.NUMERIC, 'bucket < 6')}
SELECT event_id, {_scaled(S.NUMERIC)} FROM base, stats""")
def scale(spark, sf_dir):
    df = plan.base_columns(traffic(spark, sf_dir))
    scaler = sc.fit_scaler(split(df, "train"), S.NUMERIC)
    return rounded(sc.scale(df, scaler, S.NUMERIC).select("event_id", *[f"{c}_norm" for c in S.NUMERIC]))


@query("scale_pop", f"""WITH {TRAFFIC}, {BASE}, {_stats('base', _POP, 'bucket < 6', 'stddev_pop')}
SELECT event_id, {_scaled(_POP)} FROM base, stats""")
def scale_pop(spark, sf_dir):
    df = plan.base_columns(traffic(spark, sf_dir))
    scaler = sc.fit_scaler(split(df, "train"), _POP, population=True, nulls_as_zero=True)
    return rounded(sc.scale(df, scaler, _POP, nulls_as_zero=True).select("event_id", *[f"{c}_norm" for c in _POP]))


@query("scale_eps", f"""WITH {TRAFFIC}, {BASE}, {_stats('base', _POP)}
SELECT event_id, {', '.join(r(f'({c} - m_{c}) / (s_{c} + 1e-6::DOUBLE)', f'{c}_norm') for c in _POP)} FROM base, stats""")
def scale_eps(spark, sf_dir):
    df = plan.base_columns(traffic(spark, sf_dir))
    scaled = sc.scale(df, sc.fit_scaler(df, _POP, keep_zero=True), _POP, nulls_as_zero=True, epsilon=1e-6)
    return rounded(scaled.select("event_id", *[f"{c}_norm" for c in _POP]))


@query("scale_vector", f"WITH {TRAFFIC}, {_stats('traffic', _RAW)} " + " UNION ALL ".join(
    f"SELECT event_id, {i} AS pos, {r(f'({c} - m_{c}) / s_{c}', 'value')} FROM traffic, stats" for i, c in enumerate(_RAW)))
def scale_vector(spark, sf_dir):
    vectors = sc.assemble(traffic(spark, sf_dir), _RAW)
    scaled = sc.fit_vector_scaler(vectors).transform(vectors)
    return rounded(scaled.select("event_id", F.posexplode(vector_to_array("features_scaled")).alias("pos", "value")))


# ---- sessions -----------------------------------------------------------------

SESSION = "src_port, dst_port, protocol"
ROLLING = f"""rolling AS (SELECT *, avg(bytes_log) OVER w AS prev_bytes_mean_3, avg(packet_log) OVER w AS prev_packet_mean_3,
    count(packet_count) OVER w AS prev_event_count_3 FROM base
  WINDOW w AS (PARTITION BY {SESSION} ORDER BY "timestamp", event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
STATS = f"""sessions AS (SELECT *, max(bytes_log) OVER s AS session_bytes_max, min(bytes_log) OVER s AS session_bytes_min,
    avg(packet_log) OVER s AS session_packet_mean FROM rolling WINDOW s AS (PARTITION BY {SESSION}))"""
_PREVIOUS = ("prev_bytes_mean_3", "prev_packet_mean_3", "prev_event_count_3")


@query("session_rolling", f"""WITH {TRAFFIC}, {BASE}, {ROLLING}
SELECT event_id, {r('prev_bytes_mean_3')}, {r('prev_packet_mean_3')}, prev_event_count_3 FROM rolling""")
def session_rolling(spark, sf_dir):
    df = traffic(spark, sf_dir).withColumns(flow.log_columns())
    return rounded(sessions.session_rolling(df).select("event_id", *_PREVIOUS))


@query("session_rolling_filled", f"""WITH {TRAFFIC}, {BASE}, {ROLLING}
SELECT event_id, {r('coalesce(prev_bytes_mean_3, 0)', 'prev_bytes_mean_3')},
  {r('coalesce(prev_packet_mean_3, 0)', 'prev_packet_mean_3')}, prev_event_count_3 FROM rolling""")
def session_rolling_filled(spark, sf_dir):
    df = traffic(spark, sf_dir).withColumns(flow.log_columns())
    return rounded(sessions.session_rolling(df, fill=0.0).select("event_id", *_PREVIOUS))


@query("session_lag", f"""WITH {TRAFFIC} SELECT event_id,
  lag(packet_count) OVER (PARTITION BY {SESSION} ORDER BY "timestamp", event_id) AS previous_packets FROM traffic""")
def session_lag(spark, sf_dir):
    df = traffic(spark, sf_dir)
    return sessions.session_lag(df, "packet_count", "previous_packets").select("event_id", "previous_packets")


@query("session_stats", f"""WITH {TRAFFIC}, {BASE}, {ROLLING}, {STATS}
SELECT event_id, {r('session_bytes_max')}, {r('session_bytes_min')}, {r('session_packet_mean')} FROM sessions""")
def session_stats(spark, sf_dir):
    df = traffic(spark, sf_dir).withColumns(flow.log_columns())
    return rounded(sessions.session_stats(df).select("event_id", *sessions.STATISTICS))


# ---- feature sets ---------------------------------------------------------------

@query("features_final", f"WITH {FINAL} SELECT {FINAL_COLUMNS} FROM final WHERE bucket < 6")
def features_final(spark, sf_dir):
    train = split(traffic(spark, sf_dir), "train")
    return rounded(plan.apply_base(train, plan.fit_base(train), keep=("event_id",)))


@query("features_val", f"WITH {FINAL} SELECT {FINAL_COLUMNS} FROM final WHERE bucket IN (6, 7)")
def features_val(spark, sf_dir):
    flows = traffic(spark, sf_dir)
    return rounded(plan.apply_base(split(flows, "val"), plan.fit_base(split(flows, "train")), keep=("event_id",)))


_FULL = f"""{TRAFFIC}, {BASE}, {ROLLING}, {_encoders(order='n DESC, v')},
extended AS (SELECT *, packet_count / (bytes_transferred + 1.0::DOUBLE) AS pkt_per_byte,
  CASE WHEN dst_port IN (21, 22, 23, 25, 53, 80, 110, 143, 443) THEN 1 ELSE 0 END AS dst_well_known,
  CAST(trunc(src_port / 10000.0::DOUBLE) AS INTEGER) AS src_port_bucket,
  {', '.join(_indexed(c) for c in S.CATEGORICAL)} FROM rolling)"""
_DOUBLES = ("bytes_transferred", "bytes_log", "packet_log", "pkt_per_byte", "hour_sin", "hour_cos",
            "prev_bytes_mean_3", "prev_packet_mean_3")


@query("features_full", f"""WITH {_FULL} SELECT event_id,
  {', '.join(r(c) if c in _DOUBLES else c for c in S.EXTENDED_FEATURES)} FROM extended""")
def features_full(spark, sf_dir):
    df = traffic(spark, sf_dir)
    out = plan.apply_extended(df, plan.fit_extended_encoders(df))
    return rounded(out.select("event_id", *S.EXTENDED_FEATURES))


_FILLED = f"""filled AS (SELECT event_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in S.EXTENDED_FEATURES)}
  FROM extended)"""


@query("features_full_scaled", f"WITH {_FULL}, {_FILLED}, {_stats('filled', S.EXTENDED_FEATURES)} " + " UNION ALL ".join(
    f"SELECT event_id, {i} AS pos, {r(f'({c} - m_{c}) / s_{c}', 'value')} FROM filled, stats"
    for i, c in enumerate(S.EXTENDED_FEATURES)))
def features_full_scaled(spark, sf_dir):
    vectors = plan.extended_vectors(traffic(spark, sf_dir))
    return rounded(vectors.select("event_id", F.posexplode(vector_to_array("features_scaled")).alias("pos", "value")))



def _session_sql() -> str:
    """Parameters from the train split, applied to the val split; each split has its own windows."""
    def derived(name: str, where: str) -> str:
        rolling = ROLLING.replace("rolling AS", f"{name}_r AS").replace("FROM base", f"FROM (SELECT * FROM base WHERE {where})")
        stats = STATS.replace("sessions AS", f"{name}_s AS").replace("FROM rolling", f"FROM {name}_r")
        columns = f"""{name} AS (SELECT event_id, attack, CAST(src_port AS DOUBLE) AS src_port, CAST(dst_port AS DOUBLE) AS dst_port,
  CAST(packet_count AS DOUBLE) AS packet_count, bytes_transferred, bytes_log, packet_log,
  bytes_transferred / (packet_count + 1) AS bytes_per_packet, ln(1 + bytes_transferred / (packet_count + 1)) AS bytes_per_packet_log,
  coalesce(prev_bytes_mean_3, 0) AS prev_bytes_mean_3, coalesce(prev_packet_mean_3, 0) AS prev_packet_mean_3,
  CAST(prev_event_count_3 AS DOUBLE) AS prev_event_count_3, session_bytes_max, session_bytes_min, session_packet_mean,
  {_indexed('protocol')}, {_indexed('conn_state')}, CAST("timestamp" AS DOUBLE) AS timestamp_epoch FROM {name}_s)"""
        return f"{rolling}, {stats}, {columns}"
    return (f"{TRAFFIC}, {BASE}, {_encoders('bucket < 6', 'v', plan.SESSION_CATEGORICAL)}, "
            f"{derived('train', 'bucket < 6')}, {derived('val', 'bucket IN (6, 7)')}, "
            f"{_stats('train', S.SESSION_FEATURES, 'true', 'stddev_pop')}")


@query("features_session", f"WITH {_session_sql()} SELECT event_id, {_scaled(S.SESSION_FEATURES)}, attack FROM val, stats")
def features_session(spark, sf_dir):
    flows = traffic(spark, sf_dir)
    fitted = plan.fit_session(split(flows, "train"))
    return rounded(plan.apply_session(split(flows, "val"), fitted, keep=("event_id",)))


@query("three_splits", f"WITH {FINAL} SELECT {SPLIT_SQL} AS split, {', '.join(S.FEATURES)}, attack FROM final")
def three_splits(spark, sf_dir):
    raw, processed, params = _raw_splits(spark, sf_dir), new_dir(spark, "processed"), new_dir(spark, "params")
    job.prepare_all(spark, raw, processed, params)
    return rounded(job.read_splits(spark, processed))


# each flow several times under many protocols: a vocabulary of more than 100,000 values from sf0.01 on
_WIDE = 20
_WIDE_VALUES = 150_000


@query("three_splits_wide", f"""WITH {TRAFFIC}, wide AS (
  SELECT event_id, bucket, {SPLIT_SQL} AS split, 'P' || CAST((event_id * {_WIDE} + i.range) % {_WIDE_VALUES} AS VARCHAR) AS protocol
  FROM traffic, range({_WIDE}) i),
vocabulary AS (SELECT protocol, row_number() OVER (ORDER BY protocol) - 1 AS idx
  FROM (SELECT DISTINCT protocol FROM wide WHERE bucket < 6))
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(coalesce(idx, -1)) AS BIGINT) AS sum_idx,
  CAST(count(*) FILTER (idx IS NULL) AS BIGINT) AS n_unseen FROM wide LEFT JOIN vocabulary USING (protocol) GROUP BY split""")
def three_splits_wide(spark, sf_dir):
    root, processed, params = new_dir(spark, "raw"), new_dir(spark, "processed"), new_dir(spark, "params")
    wide = traffic(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_WIDE - 1))))
    named = F.concat(F.lit("P"), ((F.col("event_id") * _WIDE + F.col("i")) % _WIDE_VALUES).cast("string"))
    wide = wide.withColumn("protocol", named)
    for name in S.SPLITS:
        parquet.write(split(wide, name).select(*FLOW_COLUMNS), parquet.split_path(root, name))
    job.prepare_all(spark, root, processed, params)
    idx = F.col("protocol_idx")
    return job.read_splits(spark, processed).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(idx.cast("long")).alias("sum_idx"), F.count(F.when(idx < 0, 1)).alias("n_unseen")
    )


@query("read_size", "SELECT event_id, value FROM events")
def read_size(spark, sf_dir):
    parquet.set_read_size(configure(spark), 128)
    return parquet.scan(spark, f"{sf_dir}/events.parquet", "event_id long, value double")


@query("serving_defaults", f"""WITH {TRAFFIC}, {_stats('traffic', ('src_port',))}
SELECT event_id, {r('(src_port - m_src_port) / s_src_port', 'src_port_norm')}, {r('CAST(packet_count AS DOUBLE)', 'packet_count_norm')}
FROM traffic, stats""")
def serving_defaults(spark, sf_dir):
    """A column without parameters is scaled with mean 0 and deviation 1."""
    df = traffic(spark, sf_dir)
    scaled = sc.scale(df, sc.fit_scaler(df, ("src_port",)), ("src_port", "packet_count"))
    return rounded(scaled.select("event_id", "src_port_norm", "packet_count_norm"))


@query("constant_eps", f"""WITH {TRAFFIC} SELECT event_id, {r('(CAST(packet_count AS DOUBLE) - 5) / 1e-6::DOUBLE', 'packet_count_norm', 1)}
FROM traffic""")
def constant_eps(spark, sf_dir):
    """Scaled by the epsilon alone: the column is constant where the scaler is fitted."""
    df = traffic(spark, sf_dir)
    constant = df.withColumn("packet_count", F.lit(5))
    scaler = sc.fit_scaler(constant, ("packet_count",), population=True, keep_zero=True)
    return rounded(sc.scale(df, scaler, ("packet_count",), epsilon=1e-6).select("event_id", "packet_count_norm"), 1)


@query("feature_registry", f"WITH {FINAL} SELECT {FINAL_COLUMNS} FROM final")
def feature_registry(spark, sf_dir):
    named = plan.feature_set("base")
    flows = traffic(spark, sf_dir)
    return rounded(named.apply(flows, named.fit(split(flows, "train")), keep=("event_id",)))


@query("event_ids", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_ids FROM events")
def event_ids(spark, sf_dir):
    made = events(spark, sf_dir).select(new_event_id().alias("id"))
    return made.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))

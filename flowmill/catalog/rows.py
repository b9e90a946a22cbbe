"""Validation, JSON, rule labels, samples, metrics and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog.fixture import (
    ARGMAX, CONCEPT, NORMAL, PREDICTIONS, SPLIT_SQL, TRAFFIC, UNITS, event_messages, events,
    predictions, requests, split, traffic,
)
from flowmill.catalog.registry import query, r, rounded
from flowmill.functions import messages, scalar, scores
from flowmill.operators import labelling, metrics, sampling
from flowmill.operators import validate as val
from flowmill.plans import splits as job
from flowmill.plans.train import TREE_PARAMS
from flowmill.sources import runs
from flowmill.sources import schemas as S
from flowmill.sources.session import new_dir

FLOW_SQL = 'src_port, dst_port, protocol, packet_count, conn_state, bytes_transferred, "timestamp"'


def draw(key: str, seed: str) -> str:
    """SQL of ``scalar.uniform``."""
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


# ---- validation -----------------------------------------------------------------

_REPORT_COLUMNS = ("event_id", "event_type", "missing_column", "props", "ts", "user_id", "value")
_REQUIRED = ("event_id", "missing_column", "ts", "value")


@query("schema_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {int(c in _REQUIRED)} AS required, {int(c != 'missing_column')} AS present, "
    + ("CAST(0 AS BIGINT) AS non_null" if c == "missing_column" else f"count({c}) AS non_null FROM events")
    for c in _REPORT_COLUMNS))
def schema_report(spark, sf_dir):
    return val.column_report(events(spark, sf_dir), _REQUIRED)


_BROKEN = {
    "src_port": "src_port NOT BETWEEN 1024 AND 65535", "dst_port": "dst_port NOT BETWEEN 1 AND 65535",
    "protocol": "protocol NOT IN ('TCP', 'UDP', 'ICMP')", "packet_count": "packet_count NOT BETWEEN 1 AND 2000",
    "conn_state": "conn_state NOT IN ('EST', 'SYN', 'FIN', 'RST')",
    "bytes_transferred": "bytes_transferred NOT BETWEEN 0 AND 2e6", '"timestamp"': '"timestamp" IS NULL',
}
_VIOLATIONS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} IS NULL OR {rule} THEN '{c.strip(chr(34))}' END" for c, rule in _BROKEN.items()) + ")"
# gaps and out-of-domain values, so that every rule has rows that break it
_GAPS = f"""gaps AS (SELECT event_id, src_port, CASE WHEN event_id % 97 = 0 THEN 0 ELSE dst_port END AS dst_port,
  CASE WHEN event_id % 89 = 0 THEN 'GRE' ELSE protocol END AS protocol, packet_count,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE conn_state END AS conn_state, bytes_transferred, "timestamp" FROM traffic)"""


def with_gaps(spark, sf_dir):
    e = F.col("event_id")
    return traffic(spark, sf_dir).withColumns({
        "dst_port": F.when(e % 97 == 0, 0).otherwise(F.col("dst_port")),
        "protocol": F.when(e % 89 == 0, "GRE").otherwise(F.col("protocol")),
        "conn_state": F.when(e % 83 != 0, F.col("conn_state")),
    })


@query("row_rules", f"WITH {TRAFFIC}, {_GAPS} SELECT event_id, {_VIOLATIONS} AS violations, {_VIOLATIONS} = '' AS valid FROM gaps")
def row_rules(spark, sf_dir):
    checked = val.check_rows(with_gaps(spark, sf_dir))
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"), "valid")


@query("row_rules_split", f"""WITH {TRAFFIC}, {_GAPS}, checked AS (SELECT {_VIOLATIONS} AS v FROM gaps)
SELECT CASE WHEN v = '' THEN 'valid' ELSE 'rejected' END AS part, count(*) AS n FROM checked GROUP BY 1""")
def row_rules_split(spark, sf_dir):
    valid, rejected = val.split_valid(val.check_rows(with_gaps(spark, sf_dir)))
    parts = valid.select(F.lit("valid").alias("part")).unionByName(rejected.select(F.lit("rejected").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---- JSON -----------------------------------------------------------------------

_EVENT_TEXT = """CAST(to_json({'timestamp': strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%dT%H:%M:%S'),
  'event_id': CAST(event_id AS VARCHAR), 'properties': {'src_port': src_port, 'dst_port': dst_port, 'protocol': protocol,
  'packet_count': packet_count, 'conn_state': conn_state, 'bytes_transferred': bytes_transferred}, 'label': attack}) AS VARCHAR)"""


@query("event_encode", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS key, {_EVENT_TEXT} AS value FROM traffic")
def event_encode(spark, sf_dir):
    return event_messages(spark, sf_dir).select("key", "value")


@query("event_decode", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS event_id, {FLOW_SQL}, attack FROM traffic")
def event_decode(spark, sf_dir):
    flows = messages.usable(messages.decode_events(event_messages(spark, sf_dir)))
    return flows.drop("key", "value", "partition", "offset", "message_time")


@query("json_quarantine", """SELECT CAST(event_id AS VARCHAR) AS key,
  CASE WHEN event_id % 10 IN (0, 3) THEN 'unparsable' WHEN event_id % 10 IN (1, 2) THEN 'missing_field' END AS problem FROM events""")
def json_quarantine(spark, sf_dir):
    return messages.decode_events(event_messages(spark, sf_dir, broken=True)).select("key", "problem")


@query("payload_rows", f"""WITH {TRAFFIC}, numbered AS (
  SELECT event_id, 0 AS pos, * EXCLUDE (event_id) FROM traffic
  UNION ALL SELECT event_id, 1, * EXCLUDE (event_id) FROM traffic WHERE event_id % 8 = 0)
SELECT event_id AS request_id, pos,
  CASE event_id % 8 WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'missing_data' WHEN 3 THEN 'wrong_kind'
    WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'no_rows' END AS error,
  {', '.join(f'CASE WHEN event_id % 8 IN (0, 6, 7) THEN {c} END AS {c}' for c in FLOW_SQL.split(', ')[:6])},
  CASE WHEN event_id % 8 IN (0, 6) THEN "timestamp" END AS "timestamp",
  CASE WHEN event_id % 8 = 7 THEN CAST(event_id % 24 AS INTEGER) END AS hour, CASE WHEN event_id % 8 = 7 THEN 4 END AS dayofweek,
  CASE WHEN event_id % 8 = 7 THEN 0 END AS is_weekend, CASE WHEN event_id % 8 = 7 THEN 0.5::DOUBLE END AS hour_sin,
  CASE WHEN event_id % 8 = 7 THEN -0.25::DOUBLE END AS hour_cos FROM numbered""")
def payload_rows(spark, sf_dir):
    return messages.request_rows(requests(spark, sf_dir))


# ---- labels and value rules -----------------------------------------------------

@query("label_normal", f"WITH {TRAFFIC}, {UNITS}, {NORMAL} SELECT event_id, {ARGMAX} AS label FROM normal")
def label_normal(spark, sf_dir):
    return traffic(spark, sf_dir).select("event_id", scores.label("normal").alias("label"))


@query("label_concept", f"WITH {TRAFFIC}, {UNITS}, {CONCEPT} SELECT event_id, {ARGMAX} AS label FROM concept")
def label_concept(spark, sf_dir):
    return traffic(spark, sf_dir).select("event_id", scores.label("concept").alias("label"))


def _normal_draw(key: str, seed: str) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {draw(key, seed + 'a')})) "
            f"* cos(6.283185307179586::DOUBLE * {draw(key, seed + 'b')}))")


_NOISY = f"""noisy AS (SELECT event_id, [{', '.join(
    f"scores[{k + 1}] + 0.05::DOUBLE * {_normal_draw('event_id', f'42:{k}')}" for k in range(6))}] AS scores FROM concept)"""


@query("label_noise", f"WITH {TRAFFIC}, {UNITS}, {CONCEPT}, {_NOISY} SELECT event_id, {ARGMAX} AS label FROM noisy")
def label_noise(spark, sf_dir):
    return traffic(spark, sf_dir).select("event_id", scores.label("concept", noise_key="event_id").alias("label"))


@query("relabel_shift", f"""WITH {TRAFFIC}, {UNITS}, {CONCEPT}
SELECT attack AS old_label, {ARGMAX} AS new_label, count(*) AS n FROM concept GROUP BY 1, 2""")
def relabel_shift(spark, sf_dir):
    flows = traffic(spark, sf_dir).withColumn("old_label", F.col("attack"))
    relabelled = labelling.with_label(flows, "concept")
    return relabelled.groupBy("old_label", F.col("attack").alias("new_label")).agg(F.count(F.lit(1)).alias("n"))


def _between(name: str, low: str, high: str) -> str:
    return f"({low} + {draw('event_id', f'42:{name}')} * ({high} - {low}))"


@query("rule_update", f"""WITH {TRAFFIC} SELECT event_id, attack, src_port,
  CASE attack WHEN 2 THEN [21, 22, 23, 80, 443][CAST(floor({draw('event_id', '42:port')} * 5) AS INTEGER) + 1]::BIGINT ELSE dst_port END AS dst_port,
  CASE attack WHEN 1 THEN ['ICMP', 'UDP'][CAST(floor({draw('event_id', '42:protocol')} * 2) AS INTEGER) + 1] ELSE protocol END AS protocol,
  CASE attack WHEN 1 THEN CAST(floor({_between('packets', '1200.0::DOUBLE', '2000.0::DOUBLE')}) AS BIGINT)
    WHEN 2 THEN CAST(floor({_between('packets', '200.0::DOUBLE', '800.0::DOUBLE')}) AS BIGINT)
    WHEN 5 THEN CAST(floor({_between('packets', '600.0::DOUBLE', '1400.0::DOUBLE')}) AS BIGINT) ELSE packet_count END AS packet_count,
  CASE attack WHEN 3 THEN 'RST' WHEN 4 THEN 'EST' ELSE conn_state END AS conn_state,
  {r(f'''CASE attack WHEN 3 THEN {_between('bytes', '0.0::DOUBLE', '200.0::DOUBLE')}
    WHEN 4 THEN {_between('bytes', '8e5::DOUBLE', '1.3e6::DOUBLE')}
    WHEN 5 THEN {_between('bytes', '1.5e6::DOUBLE', '2e6::DOUBLE')} ELSE bytes_transferred END''', 'bytes_transferred', 4)}
FROM traffic""")
def rule_update(spark, sf_dir):
    out = labelling.apply_attack_rules(traffic(spark, sf_dir))
    return rounded(out.select("event_id", "attack", "src_port", "dst_port", "protocol", "packet_count",
                              "conn_state", "bytes_transferred"), 4)


# ---- samples --------------------------------------------------------------------

@query("sample_frac", f"SELECT event_id FROM events WHERE {draw('event_id', '42')} < 0.2")
def sample_frac(spark, sf_dir):
    return sampling.sample_fraction(events(spark, sf_dir), 0.2, "event_id").select("event_id")


@query("sample_stratified", """WITH ranked AS (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS rk,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type FROM ranked WHERE rk <= greatest(least(n, 5), CAST(floor(n * 0.2) AS BIGINT))""")
def sample_stratified(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "event_type")
    return sampling.stratified_sample(df, "event_type", 0.2, "event_id")


@query("capped_rows", """SELECT event_id, user_id FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 500""")
def capped_rows(spark, sf_dir):
    return sampling.cap_rows(events(spark, sf_dir).select("event_id", "user_id"), 500, "event_id")


@query("weighted_assign", f"""WITH drawn AS (SELECT event_id, {draw('event_id', '42')} AS u FROM events)
SELECT event_id, CAST(CASE WHEN u < 0.942 THEN 0 WHEN u < 0.962 THEN 1 WHEN u < 0.972 THEN 2 WHEN u < 0.987 THEN 3
  WHEN u < 0.995 THEN 4 ELSE 5 END AS BIGINT) AS class_id FROM drawn""")
def weighted_assign(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id")
    return sampling.assign_weighted(df, "class_id", S.CLASS_WEIGHTS, "event_id")


@query("canary_split", f"""SELECT event_id, CASE WHEN {draw('event_id', '42')} < 0.1 THEN 'canary' ELSE 'stable' END AS variant FROM events""")
def canary_split(spark, sf_dir):
    return sampling.assign_variant(events(spark, sf_dir).select("event_id"), 0.1, "event_id")


# ---- metrics on fixed predictions -------------------------------------------------

def _matrix(by: str = "") -> str:
    """SQL of the dense matrix, optionally per group expression ``by`` (named ``g``)."""
    return f"""{PREDICTIONS}, tagged AS (SELECT *, {by or "'all'"} AS g FROM predictions),
grid AS (SELECT t.g, l.range AS label, p.range AS prediction FROM (SELECT DISTINCT g FROM tagged) t, range(6) l, range(6) p),
matrix AS (SELECT c.g, c.label, c.prediction, count(x.label) AS n FROM grid c LEFT JOIN tagged x
  ON x.g = c.g AND x.label = c.label AND x.prediction = c.prediction GROUP BY ALL)"""


def _classes(by: str = "") -> str:
    return f"""{_matrix(by)},
sums AS (SELECT g, k.range AS class_id, CAST(sum(CASE WHEN label = k.range THEN n ELSE 0 END) AS BIGINT) AS support,
    CAST(sum(CASE WHEN prediction = k.range THEN n ELSE 0 END) AS BIGINT) AS predicted,
    CAST(sum(CASE WHEN label = k.range AND prediction = k.range THEN n ELSE 0 END) AS BIGINT) AS hits
  FROM matrix, range(6) k GROUP BY ALL),
rates AS (SELECT *, hits / greatest(predicted, 1) AS precision, hits / greatest(support, 1) AS recall FROM sums),
classes AS (SELECT *, 2.0::DOUBLE * precision * recall / greatest(precision + recall, 1e-12::DOUBLE) AS f1 FROM rates),
summary AS (SELECT g, sum(hits) / greatest(sum(support), 1) AS accuracy,
    {', '.join(f'avg({c}) AS {c}_macro' for c in metrics.AVERAGED)},
    {', '.join(f'sum({c} * support) / greatest(sum(support), 1) AS {c}_weighted' for c in metrics.AVERAGED)},
    CAST(sum(support) AS BIGINT) AS support FROM classes GROUP BY g)"""


_SUMMARY = ", ".join(
    [r("accuracy")] + [r(f"{c}_{k}") for k in ("macro", "weighted") for c in metrics.AVERAGED]
    + [r(f"{c}_macro", f"{c}_avg") for c in metrics.AVERAGED] + ["support"]
)


def summary_of(df, by: tuple[str, ...] = ()):
    return metrics.summary(metrics.class_metrics(metrics.confusion(df, by=by), by), by)


@query("confusion", f"WITH {_matrix()} SELECT label, prediction, n FROM matrix")
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query("confusion_norm", f"""WITH {_matrix()}, shares AS (SELECT label, prediction, n,
  n / greatest(sum(n) OVER (PARTITION BY label), 1) AS share FROM matrix)
SELECT label, prediction, n, {r('share')}, {r('share * 100.0', 'percent')} FROM shares""")
def confusion_norm(spark, sf_dir):
    return rounded(metrics.normalised(metrics.confusion(predictions(spark, sf_dir))))


@query("class_metrics", f"""WITH {_classes()} SELECT class_id, support, hits, {r('precision')}, {r('recall')}, {r('f1')} FROM classes""")
def class_metrics(spark, sf_dir):
    return rounded(metrics.class_metrics(metrics.confusion(predictions(spark, sf_dir))))


@query("metrics_summary", f"WITH {_classes()} SELECT {_SUMMARY} FROM summary")
def metrics_summary(spark, sf_dir):
    return rounded(summary_of(predictions(spark, sf_dir)))


@query("class_report", f"""WITH {_classes()}
SELECT CAST(class_id AS VARCHAR) AS name, {r('precision', digits=4)}, {r('recall', digits=4)}, {r('f1', digits=4)}, support FROM classes
UNION ALL SELECT 'accuracy', NULL, NULL, {r('accuracy', digits=4)}, support FROM summary
UNION ALL SELECT 'macro avg', {r('precision_macro', digits=4)}, {r('recall_macro', digits=4)}, {r('f1_macro', digits=4)}, support FROM summary
UNION ALL SELECT 'weighted avg', {r('precision_weighted', digits=4)}, {r('recall_weighted', digits=4)}, {r('f1_weighted', digits=4)}, support FROM summary""")
def class_report(spark, sf_dir):
    return metrics.report(metrics.class_metrics(metrics.confusion(predictions(spark, sf_dir))))


@query("accuracy", f"""WITH {PREDICTIONS}, a AS (SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM predictions) SELECT {r('accuracy')}, {r('1 - accuracy', 'merror')} FROM a""")
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(predictions(spark, sf_dir)))


@query("eval_fixed", f"WITH {_classes(SPLIT_SQL)} SELECT g AS split, {_SUMMARY} FROM summary")
def eval_fixed(spark, sf_dir):
    tagged = predictions(spark, sf_dir).withColumn("split", job.split_of())
    return rounded(summary_of(tagged, ("split",)))


_DRIFT = "CASE event_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'data' ELSE 'concept' END"


@query("drift_eval", f"WITH {_classes(_DRIFT)} SELECT g AS drift, {_SUMMARY} FROM summary")
def drift_eval(spark, sf_dir):
    kind = F.col("event_id") % 3
    drift = F.when(kind == 0, "normal").when(kind == 1, "data").otherwise("concept")
    return rounded(summary_of(predictions(spark, sf_dir).withColumn("drift", drift), ("drift",)))


@query("label_counts", f"WITH {PREDICTIONS} SELECT prediction, count(*) AS n FROM predictions GROUP BY 1 ORDER BY n DESC, 1")
def label_counts(spark, sf_dir):
    return metrics.value_counts(predictions(spark, sf_dir), "prediction")


@query("num_classes", f"WITH {TRAFFIC} SELECT count(DISTINCT attack) AS num_classes FROM traffic WHERE bucket < 8")
def num_classes(spark, sf_dir):
    flows = traffic(spark, sf_dir)
    return metrics.class_count([split(flows, "train"), split(flows, "val")], "attack")


@query("log_loss", f"""WITH {TRAFFIC}, {UNITS}, {CONCEPT},
p AS (SELECT *, list_transform(scores, lambda x: exp(x - list_max(scores))) AS powers FROM concept),
loss AS (SELECT {SPLIT_SQL} AS split, -ln(greatest(powers[attack + 1] / list_sum(powers), 1e-15::DOUBLE)) AS loss,
  CASE WHEN {ARGMAX} <> attack THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wrong FROM p)
SELECT split, {r('avg(loss)', 'mlogloss')}, {r('avg(wrong)', 'merror')}, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_excluded FROM loss GROUP BY split""")
def log_loss(spark, sf_dir):
    scored = traffic(spark, sf_dir).select(
        job.split_of().alias("split"), F.col("attack").alias("label"), F.array(*scores.concept_scores()).alias("scores")
    )
    return rounded(metrics.log_loss(scalar.with_softmax(scored, "scores", "probability"), by=("split",)))


# ---- runs -----------------------------------------------------------------------

_SUMMARY_NAMES = ["accuracy"] + [f"{c}_{k}" for k in ("macro", "weighted", "avg") for c in metrics.AVERAGED] + ["support"]
_LOGGED = {"framework": "trees", "target": "attack", "num_classes": "6"} | {f"xgb_{k}": str(v) for k, v in TREE_PARAMS.items()}
_NUL = "CAST(NULL AS VARCHAR)"


@query("run_log", f"WITH {_classes(SPLIT_SQL)} " + " UNION ALL ".join(
    [f"SELECT 'rule-000' AS run_id, 'param' AS kind, '{k}' AS name, '{v}' AS text, CAST(NULL AS DOUBLE) AS number" for k, v in _LOGGED.items()]
    + [f"SELECT 'rule-000', 'metric', g || '_{c}', {_NUL}, {r('CAST(' + c.replace('_avg', '_macro') + ' AS DOUBLE)', 'number')} FROM summary"
       for c in _SUMMARY_NAMES]))
def run_log(spark, sf_dir):
    tagged = predictions(spark, sf_dir).withColumn("split", job.split_of())
    path = new_dir(spark, "runs")
    runs.append(runs.param_rows(spark, "rule-000", "trees", {"target": "attack", "num_classes": 6}, TREE_PARAMS), path)
    runs.append(runs.metric_table_rows(summary_of(tagged, ("split",)), "rule-000", "split"), path)
    return rounded(spark.read.schema(runs.RUN_SCHEMA).parquet(path))


@query("best_run", f"""WITH {TRAFFIC}, {UNITS}, {CONCEPT}, {NORMAL}, runs AS (
  SELECT 'always-0' AS run_id, avg(CASE WHEN attack = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS number FROM traffic
  UNION ALL SELECT 'concept', avg(CASE WHEN {ARGMAX} = attack THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM concept
  UNION ALL SELECT 'normal', avg(CASE WHEN {ARGMAX} = attack THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM normal)
SELECT run_id, {r('number')} FROM runs ORDER BY number, run_id LIMIT 1""")
def best_run(spark, sf_dir):
    guesses = {"always-0": F.lit(0), "concept": scores.label("concept"), "normal": scores.label("normal")}
    errors = traffic(spark, sf_dir).agg(
        *[F.avg((g != F.col("attack")).cast("double")).alias(n) for n, g in guesses.items()]
    )
    table = errors.unpivot([], list(guesses), "run_id", "number").withColumn("name", F.lit("merror"))
    return rounded(runs.best_run(table, "merror"))

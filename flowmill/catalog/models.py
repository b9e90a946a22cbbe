"""Training, tuning, scoring and retraining over the ``traffic`` splits."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.catalog.base import UNROUNDED, fitted_base
from flowmill.catalog.fixture import ARGMAX, PREDICTIONS, SPLIT_SQL, TRAFFIC, predictions, requests, traffic
from flowmill.catalog.registry import query, r, rounded
from flowmill.catalog.rows import draw
from flowmill.operators import labelling, metrics
from flowmill.plans import features as plan
from flowmill.plans import score as scoring
from flowmill.plans import train, training, trees, tune
from flowmill.plans.predict import weights
from flowmill.plans.splits import split_of
from flowmill.plans.train import Model
from flowmill.sources import models as stored
from flowmill.sources import parquet, runs
from flowmill.sources import schemas as S
from flowmill.sources.session import new_dir

_TRAINED: dict[tuple[str, str, str], str] = {}


def feature_rows(spark, sf_dir):
    """All flows as features, with their key and split; parameters come from the train split."""
    flows = traffic(spark, sf_dir).withColumn("split", split_of())
    return plan.apply_base(flows, fitted_base(spark, sf_dir), keep=("event_id", "split"))


def model(spark, sf_dir: str, framework: str = "trees", refresh: bool = False) -> Model:
    """Model of the train split, trained once per session and table folder, then loaded."""
    key = (spark.sparkContext.applicationId, sf_dir, framework)
    if refresh or key not in _TRAINED:
        fitted = train.fit(framework, feature_rows(spark, sf_dir).filter("split = 'train'"))
        root = new_dir(spark, "models")
        stored.save_model(fitted, root, framework)
        _TRAINED[key] = root
    return stored.load_model(_TRAINED[key], framework)


def quality(scored: DataFrame) -> DataFrame:
    """Per split: its rows, the share of its most frequent class, and whether the model does better than that
    share and than equal probabilities."""
    tables = scoring.evaluate(scored)
    most = tables["classes"].groupBy("split").agg((F.max("support") / F.sum("support")).alias("majority"))
    each = tables["summary"].join(F.broadcast(tables["loss"]), "split").join(F.broadcast(most), "split")  # a row per split
    beats, informed = F.col("accuracy") > F.col("majority"), F.col("mlogloss") < math.log(S.NUM_CLASSES)
    return each.select("split", "support", "majority", beats.alias("beats_majority"), informed.alias("informed"))


QUALITY = f"""quality AS (SELECT split, CAST(sum(n) AS BIGINT) AS support, max(n) / sum(n) AS majority, TRUE AS beats_majority, TRUE AS informed
  FROM (SELECT {SPLIT_SQL} AS split, attack, count(*) AS n FROM traffic GROUP BY ALL) GROUP BY 1)"""


def _trained(spark, sf_dir, framework: str):
    """All rows scored by a model trained on the train split, with what is known of such a model."""
    rows = feature_rows(spark, sf_dir)
    out = scoring.score(rows, model(spark, sf_dir, framework, refresh=True), framework=framework)
    p, best = F.col("probability"), F.col("prediction")
    in_range = best.between(0, 5) & (F.get(p, best.cast("int")) == F.array_max(p)) & (F.array_min(p) >= 0)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    each = out.select("event_id", "split", in_range.alias("in_range"), total.alias("total"), "framework")
    return rounded(each.join(F.broadcast(quality(out).drop("support")), "split"))


def _trained_sql(framework: str) -> str:
    return f"""WITH {TRAFFIC}, {QUALITY} SELECT event_id, split, TRUE AS in_range, 1.0::DOUBLE AS total, '{framework}' AS framework,
  {r('majority')}, beats_majority, informed FROM (SELECT event_id, {SPLIT_SQL} AS split FROM traffic) JOIN quality USING (split)"""


@query("train_trees", _trained_sql("trees"))
def train_trees(spark, sf_dir):
    return _trained(spark, sf_dir, "trees")


@query("train_mlp", _trained_sql("net"))
def train_mlp(spark, sf_dir):
    return _trained(spark, sf_dir, "net")


STUMP_FEATURES = ("dst_port", "hour", "packet_count", "conn", "parity")
STUMP = train.TREE_PARAMS | {"rounds": 1, "max_depth": 1, "eta": 0.5, "lambda": 1.5, "alpha": 2.0, "min_child_weight": 40}
_UNIT = 1 << 24
_CONN = "CASE conn_state WHEN 'EST' THEN 0 WHEN 'SYN' THEN 1 WHEN 'FIN' THEN 2 ELSE 3 END"


def _t(g: str) -> str:
    return f"(sign({g}) * greatest(abs({g}) - 2.0, 0.0))"


STUMP_SQL = f"""WITH {TRAFFIC}, wide AS (SELECT event_id, {SPLIT_SQL} AS split, attack, dst_port::DOUBLE AS dst_port, hour(make_timestamp("timestamp" * 1000000))::DOUBLE AS hour,
  packet_count::DOUBLE AS packet_count, ({_CONN})::DOUBLE AS conn, (src_port % 2)::DOUBLE AS parity FROM traffic),
class AS (SELECT range AS k FROM range(6)),
value AS (SELECT name, x, CASE name {' '.join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(STUMP_FEATURES))} END AS f, attack
  FROM (UNPIVOT wide ON {', '.join(STUMP_FEATURES)} INTO NAME name VALUE x) WHERE split = 'train'),
cell AS (SELECT f, x, k, sum(round((1::DOUBLE / 6 - CASE WHEN attack = k THEN 1 ELSE 0 END) * {_UNIT}))::HUGEINT AS g,
  sum(round(6::DOUBLE / 5 * (1::DOUBLE / 6) * (1 - 1::DOUBLE / 6) * {_UNIT}))::HUGEINT AS h FROM value, class GROUP BY ALL),
side AS (SELECT f, k, x, sum(g) OVER upto - g AS gi, sum(h) OVER upto - h AS hi, sum(g) OVER whole AS gt, sum(h) OVER whole AS ht FROM cell
  WINDOW upto AS (PARTITION BY f, k ORDER BY x), whole AS (PARTITION BY f, k)),
real AS (SELECT f, k, x, gi::DOUBLE / {_UNIT} AS gl, hi::DOUBLE / {_UNIT} AS hl, (gt - gi)::DOUBLE / {_UNIT} AS gr, (ht - hi)::DOUBLE / {_UNIT} AS hr,
  gt::DOUBLE / {_UNIT} AS g, ht::DOUBLE / {_UNIT} AS h FROM side WHERE hi > 0),
gain AS (SELECT *, {_t('gl')} * {_t('gl')} / (hl + 1.5) + {_t('gr')} * {_t('gr')} / (hr + 1.5) - {_t('g')} * {_t('g')} / (h + 1.5) AS gain
  FROM real WHERE hl >= 40 AND hr >= 40),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, x) AS nth FROM gain) WHERE nth = 1 AND gain > 1e-6),
root AS (SELECT k, any_value(g) AS g, any_value(h) AS h FROM real GROUP BY 1),
leaf AS (SELECT root.k, f, x, -0.5 * {_t('root.g')} / (root.h + 1.5) AS alone, -0.5 * {_t('gl')} / (hl + 1.5) AS below, -0.5 * {_t('gr')} / (hr + 1.5) AS above
  FROM root LEFT JOIN best ON best.k = root.k),
margin AS (SELECT event_id, split, leaf.k, CASE WHEN f IS NULL THEN alone WHEN [{', '.join(STUMP_FEATURES)}][f + 1] < x THEN below ELSE above END AS m FROM wide, leaf),
power AS (SELECT event_id, split, k, exp(m - max(m) OVER (PARTITION BY event_id)) AS e FROM margin)
SELECT event_id, split, k AS class, {r('e / sum(e) OVER (PARTITION BY event_id)', 'probability', 5)} FROM power"""


@query("train_stumps", STUMP_SQL)
def train_stumps(spark, sf_dir):
    """One boosting round of depth 1: sums, splits, weights and scores, all of them as SQL finds them."""
    state = F.when(F.col("conn_state") == "EST", 0).when(F.col("conn_state") == "SYN", 1).when(F.col("conn_state") == "FIN", 2).otherwise(3)
    wide = traffic(spark, sf_dir).select(
        "event_id", split_of().alias("split"), F.col("attack").alias("label"), F.col("dst_port").cast("double"),
        F.hour(F.timestamp_seconds("timestamp")).cast("double").alias("hour"), F.col("packet_count").cast("double"),
        state.cast("double").alias("conn"), (F.col("src_port") % 2).cast("double").alias("parity"))
    stumps = trees.fit(wide.filter("split = 'train'"), STUMP_FEATURES, "label", S.NUM_CLASSES, [STUMP])[0]
    scored = wide.select("event_id", "split", weights(stumps).alias("p"))
    return rounded(scored.select("event_id", "split", F.posexplode("p").alias("class", "probability")).withColumn("class", F.col("class").cast("long")), 5)


@query("score_batch", f"""WITH {TRAFFIC} SELECT event_id, {SPLIT_SQL} AS split, CAST(6 AS INTEGER) AS n_classes, TRUE AS best,
  'stable' AS variant, 'trees' AS framework, 'model_trees' AS model_key FROM traffic""")
def score_batch(spark, sf_dir):
    out = scoring.score(feature_rows(spark, sf_dir), model(spark, sf_dir))
    best = F.get("probability", F.col("prediction").cast("int")) == F.array_max("probability")
    return out.select("event_id", "split", F.size("probability").alias("n_classes"), best.alias("best"), "variant", "framework", "model_key")


@query("model_roundtrip", "SELECT event_id, TRUE AS same FROM events")
def model_roundtrip(spark, sf_dir):
    """A model read back from storage predicts what the saved one does."""
    rows, root = feature_rows(spark, sf_dir), new_dir(spark, "models")
    kept = model(spark, sf_dir)
    stored.save_model(kept, root, "trees")
    again = stored.load_model(root, "trees", refresh=True)
    a = scoring.score(rows, kept).select("event_id", "probability")
    b = scoring.score(rows, again).select("event_id", F.col("probability").alias("again"))
    return a.join(b, "event_id").select("event_id", (F.col("probability") == F.col("again")).alias("same"))


# a fixed linear model as the model from outside: weights of each class for three columns
_WEIGHTS = {"bytes_log_norm": (0.1, 0.9, -0.4, 0.2, 1.1, -0.7), "packet_log_norm": (0.3, -0.6, 0.8, 0.1, -0.2, 0.5),
            "hour_sin_norm": (0.5, 0.2, -0.3, -0.9, 0.4, 0.6)}
_LINEAR = ", ".join(" + ".join(f"{c} * {w[k]}::DOUBLE" for c, w in _WEIGHTS.items()) for k in range(6))


@query("score_foreign", f"""WITH {UNROUNDED}, scored AS (SELECT event_id, [{_LINEAR}] AS scores, bucket FROM final),
powers AS (SELECT event_id, bucket, scores, list_transform(scores, lambda x: exp(x - list_max(scores))) AS p FROM scored)
SELECT event_id, {SPLIT_SQL} AS split, {ARGMAX} AS prediction, {r('list_max(p) / list_sum(p)', 'confidence')}, 'linear' AS framework FROM powers""")
def score_foreign(spark, sf_dir):
    weights = np.array(list(_WEIGHTS.values()))

    def predict(x: np.ndarray) -> np.ndarray:
        z = x @ weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    rows = feature_rows(spark, sf_dir).select("event_id", "split", *_WEIGHTS)
    out = scoring.score_foreign(rows, predict, tuple(_WEIGHTS), framework="linear")
    return rounded(out.select("event_id", "split", "prediction", F.array_max("probability").alias("confidence"), "framework"))


@query("score_canary", f"""WITH drawn AS (SELECT event_id, {draw('event_id', '42')} < 0.1 AS canary FROM events)
SELECT event_id, CASE WHEN canary THEN 'canary' ELSE 'stable' END AS variant, CASE WHEN canary THEN 'net' ELSE 'trees' END AS framework,
  CASE WHEN canary THEN 'model_net' ELSE 'model_trees' END AS model_key, TRUE AS in_range FROM drawn""")
def score_canary(spark, sf_dir):
    models = [scoring.Tagged(model(spark, sf_dir, f), f) for f in ("trees", "net")]
    out = scoring.score_routed(feature_rows(spark, sf_dir), *models, 0.1)
    return out.select("event_id", "variant", "framework", "model_key", F.col("prediction").between(0, 5).alias("in_range"))


@query("score_requests", """WITH kind AS (SELECT event_id AS request_id,
  CASE event_id % 8 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 6 THEN CAST(1 AS BIGINT) WHEN 7 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_predictions,
  CASE event_id % 8 WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'missing_data' WHEN 3 THEN 'wrong_kind'
    WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'no_rows' END AS error FROM events)
SELECT *, n_predictions AS n_probabilities, CASE WHEN error IS NULL THEN TRUE END AS best, CASE WHEN error IS NULL THEN n_predictions::DOUBLE END AS total,
  CASE WHEN error IS NULL THEN 'stable/trees/model_trees' END AS tag, error AS said FROM kind""")
def score_requests(spark, sf_dir):
    """Replies taken apart again: each prediction is the first largest of its probabilities, which sum to 1."""
    replies = scoring.answer_requests(requests(spark, sf_dir), fitted_base(spark, sf_dir), model(spark, sf_dir))
    said = F.from_json("reply", """predictions array<bigint>, probabilities array<array<double>>, error string,
        model struct<variant string, framework string, model_key string>""")
    pairs = F.arrays_zip(F.col("said.predictions").alias("k"), F.col("said.probabilities").alias("p"))
    best = F.forall(pairs, lambda x: x["k"] == F.array_position(x["p"], F.array_max(x["p"])) - 1)
    total = F.aggregate(F.flatten("said.probabilities"), F.lit(0.0), lambda a, p: a + p)
    tag = F.when(F.col("said.model").isNotNull(), F.concat_ws("/", "said.model.variant", "said.model.framework", "said.model.model_key"))
    parts = replies.withColumn("said", said).select(
        "request_id", "n_predictions", "error", F.coalesce(F.size("said.probabilities"), F.lit(0)).cast("long").alias("n_probabilities"),
        best.alias("best"), total.alias("total"), tag.alias("tag"), F.col("said.error").alias("said"))
    return rounded(parts)


@query("eval_by_split", f"""WITH {TRAFFIC} SELECT {SPLIT_SQL} AS split, CAST(count(*) AS BIGINT) AS support,
  CAST(count(*) AS BIGINT) AS n_rows, TRUE AS in_range, TRUE AS informed FROM traffic GROUP BY 1""")
def eval_by_split(spark, sf_dir):
    tables = scoring.evaluate(scoring.score(feature_rows(spark, sf_dir), model(spark, sf_dir)))
    both = tables["summary"].join(F.broadcast(tables["loss"]), "split")
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision_macro", "recall_weighted", "f1_avg", "merror")]
    agree = F.abs(1 - F.col("accuracy") - F.col("merror")) < 1e-9
    return both.select("split", "support", "n_rows", reduce(and_, shares, agree & (F.col("mlogloss") > 0)).alias("in_range"),
                       (F.col("mlogloss") < math.log(S.NUM_CLASSES)).alias("informed"))


@query("evaluation_saved", f"""WITH {PREDICTIONS}, grid AS (SELECT l.range AS label, p.range AS prediction FROM range(6) l, range(6) p)
SELECT 'val' AS split, g.label, g.prediction, count(x.label) AS n FROM grid g LEFT JOIN predictions x
  ON x.label = g.label AND x.prediction = g.prediction GROUP BY ALL""")
def evaluation_saved(spark, sf_dir):
    root = new_dir(spark, "evaluation")
    stored.save_evaluation(root, "r1", {"confusion_matrix": metrics.confusion(predictions(spark, sf_dir))})
    return spark.read.parquet(f"{root}/confusion_matrix").filter("run_id = 'r1'").select("split", "label", "prediction", "n")


@query("checked_splits", f"""WITH {TRAFFIC} SELECT {SPLIT_SQL} AS split, CAST(count(*) AS BIGINT) AS n_rows FROM traffic GROUP BY 1""")
def checked_splits(spark, sf_dir):
    """The three splits of a training job, each with its target and features."""
    processed, rows = new_dir(spark, "processed"), feature_rows(spark, sf_dir)
    for name in S.SPLITS:
        parquet.write(rows.filter(F.col("split") == name).drop("split"), parquet.split_path(processed, name))
    counts = [df.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows")) for name, df in training.load_splits(spark, processed).items()]
    return reduce(DataFrame.unionByName, counts)


def _trials(spark, trials):
    """What holds for a search: finite losses, one best run better than equal probabilities, and parameters that matter."""
    best = runs.best_run(trials, "mlogloss").select("run_id", F.col("number").alias("best"))
    return trials.join(F.broadcast(best), "run_id", "left").agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_distinct("params").alias("n_params"), F.count("best").alias("n_best"),
        (F.min("best") == F.min("number")).alias("best_is_smallest"), (F.count_distinct("number") > 1).alias("losses_differ"),
        F.bool_and(F.col("number").between(1e-9, 1e9)).alias("finite"), (F.min("number") < math.log(S.NUM_CLASSES)).alias("informed"),
    )


def _trials_sql(n: int) -> str:
    return f"""SELECT CAST({n} AS BIGINT) AS n_trials, CAST({n} AS BIGINT) AS n_params, CAST(1 AS BIGINT) AS n_best,
  TRUE AS best_is_smallest, TRUE AS losses_differ, count(*) > 0 AS finite, TRUE AS informed FROM events"""


@query("tune_random", _trials_sql(3))
def tune_random(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    trials = tune.random_search(
        rows.filter("split = 'train'"), rows.filter("split = 'val'"), max_train_rows=250_000,
    )
    return _trials(spark, trials)


@query("tune_net", _trials_sql(3))
def tune_net(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    trials = tune.random_search(
        rows.filter("split = 'train'"), rows.filter("split = 'val'"), "net", trials=3, max_train_rows=250_000, hidden=(32,),
    )
    return _trials(spark, trials)


@query("retrain_eval", f"""WITH {TRAFFIC} SELECT {SPLIT_SQL} AS split, CAST(count(*) AS BIGINT) AS support, TRUE AS better
FROM traffic GROUP BY 1""")
def retrain_eval(spark, sf_dir):
    """The model of the old labels against one trained on the concept rule's labels."""
    shifted = labelling.with_label(traffic(spark, sf_dir).withColumn("split", split_of()), "concept")
    rows = plan.apply_base(shifted, fitted_base(spark, sf_dir), keep=("event_id", "split"))
    again = train.fit("trees", rows.filter("split = 'train'"))
    before, after = (
        scoring.compare_drift({name: rows}, m, by=("split",)).select("split", "support", F.col("accuracy").alias(name))
        for name, m in (("before", model(spark, sf_dir)), ("after", again))
    )
    return before.join(after.drop("support"), "split").select("split", "support", (F.col("after") > F.col("before")).alias("better"))


@query("drift_model", f"""WITH {TRAFFIC} SELECT d.drift, {SPLIT_SQL} AS split, CAST(count(*) AS BIGINT) AS support, TRUE AS in_range,
  CASE d.drift WHEN 'concept_drift' THEN TRUE END AS worse
FROM traffic, (VALUES ('normal'), ('data_drift'), ('concept_drift')) d(drift) GROUP BY ALL""")
def drift_model(spark, sf_dir):
    """One model on the baseline, on shifted features and on shifted labels."""
    flows = traffic(spark, sf_dir).withColumn("split", split_of())
    fitted = fitted_base(spark, sf_dir)
    shifted = labelling.clip_ranges(flows.withColumns({
        "packet_count": F.col("packet_count") + 400, "bytes_transferred": F.col("bytes_transferred") * 1.5,
    }))
    sets = {"normal": flows, "data_drift": shifted, "concept_drift": labelling.with_label(flows, "concept")}
    rows = {k: plan.apply_base(v, fitted, keep=("split",)) for k, v in sets.items()}
    out = scoring.compare_drift(rows, model(spark, sf_dir), by=("split",))
    usual = out.filter("drift = 'normal'").select("split", F.col("accuracy").alias("usual"))  # a row per split
    worse = F.when(F.col("drift") == "concept_drift", F.col("accuracy") < F.col("usual"))
    return out.join(F.broadcast(usual), "split").select(
        "drift", "split", "support", F.col("accuracy").between(0, 1).alias("in_range"), worse.alias("worse"))

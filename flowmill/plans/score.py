"""Batch scoring, evaluation and canary routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions import scalar
from flowmill.functions.messages import request_rows
from flowmill.operators import metrics
from flowmill.operators.sampling import assign_variant
from flowmill.plans.features import Fitted, apply_base
from flowmill.plans.predict import weights
from flowmill.plans.train import Model
from flowmill.sources.schemas import FEATURES, TARGET
from flowmill.sources.session import pinned


def _ready(features: DataFrame) -> DataFrame:
    """Features with nulls as 0 beside the columns as they came, which go out again."""
    kept = F.struct(*[F.col(f"`{c}`") for c in features.columns]).alias("_kept")
    return features.select("*", kept).fillna(0.0, subset=list(FEATURES))


def weigh(features: DataFrame, models: dict[str, Model], keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and each model's class probabilities as an array by its name; null features count as 0."""
    return _ready(features).select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], *[weights(m).alias(n) for n, m in models.items()])


def _predicted(weighted: DataFrame, columns: list[str], tags: list[Column]) -> DataFrame:
    # the weights get a projection of their own: they are used several times below
    total = F.greatest(F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w), F.lit(1e-300))
    summed = weighted.withColumn("_total", total)
    return summed.select(
        *[F.col(f"_kept.`{c}`").alias(c) for c in columns],
        scalar.argmax(F.col("_weights")).alias("prediction"),
        F.transform("_weights", lambda w: w / F.col("_total")).alias("probability"), *tags,
    )


def score(
    features: DataFrame, model: Model, variant: str = "stable", framework: str = "trees",
    model_key: str | None = None,
) -> DataFrame:
    """Input columns plus ``prediction``, ``probability`` (array) and the model tag.

    Works alike on batch and streaming tables. Trees are JVM expressions; a net runs once per Arrow batch.
    """
    weighted = _ready(features).select("_kept", weights(model).alias("_weights"))
    tags = {"variant": variant, "framework": framework, "model_key": model_key or f"model_{framework}"}
    return _predicted(weighted, features.columns, [F.lit(v).alias(k) for k, v in tags.items()])


def score_foreign(
    features: DataFrame, predict: Callable[[np.ndarray], np.ndarray], columns: tuple[str, ...] = FEATURES,
    variant: str = "stable", framework: str = "foreign", model_key: str | None = None,
) -> DataFrame:
    """:func:`score` with a model from outside Spark, called once per Arrow batch.

    ``predict`` takes a (rows, columns) array and returns (rows, classes) probabilities, or one
    probability per row for two classes. It is shipped to the workers once per task.
    """
    names = list(columns)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = np.asarray(predict(frame[names].to_numpy(dtype=float, na_value=0.0)), dtype=float)
            two = np.stack([1.0 - p, p], axis=1) if p.ndim == 1 else p
            best = (p > 0.5) if p.ndim == 1 else p.argmax(axis=1)
            yield frame.assign(prediction=best.astype("int64"), probability=list(two))

    schema = T.StructType([
        *features.schema.fields,
        T.StructField("prediction", T.LongType()),
        T.StructField("probability", T.ArrayType(T.DoubleType())),
    ])
    tags = {"variant": variant, "framework": framework, "model_key": model_key or f"model_{framework}"}
    return features.mapInPandas(batches, schema).withColumns({k: F.lit(v) for k, v in tags.items()})


@dataclass(frozen=True)
class Tagged:
    """A model and the names its predictions carry."""

    model: Model
    framework: str = "trees"
    model_key: str | None = None

    @property
    def key(self) -> str:
        return self.model_key or f"model_{self.framework}"


def score_routed(
    features: DataFrame, stable: Tagged, canary: Tagged, share: float, key: str = "event_id", seed: int = 42,
) -> DataFrame:
    """Score a ``share`` of rows with the canary model and the rest with the stable one, in one pass
    over the input; every row is tagged with the model that scored it."""
    routed = _ready(assign_variant(features.drop("variant"), share, key, seed).withColumnRenamed("variant", "_variant"))
    columns = [c for c in features.columns if c != "variant"]
    is_canary = F.col("_variant") == "canary"
    # each model sees its own rows only
    chosen = routed.select("_kept", "_variant", F.coalesce(weights(canary.model, is_canary), weights(stable.model, ~is_canary)).alias("_weights"))
    tags = [
        F.col("_variant").alias("variant"),
        F.when(is_canary, canary.framework).otherwise(stable.framework).alias("framework"),
        F.when(is_canary, canary.key).otherwise(stable.key).alias("model_key"),
    ]
    return _predicted(chosen, columns, tags)


def replies(scored: DataFrame, keep: tuple[str, ...], error: str | None = None) -> DataFrame:
    """Reply text per row: prediction, probabilities and model, or the reason of a bad request."""
    answer = F.to_json(F.struct(
        F.array("prediction").alias("predictions"), F.array("probability").alias("probabilities"),
        F.struct("variant", "framework", "model_key").alias("model"),
    ))
    if error is not None:
        answer = F.when(F.col(error).isNull(), answer).otherwise(F.to_json(F.struct(F.col(error).alias("error"))))
    return scored.select(*keep, answer.alias("reply"))


def answer_requests(
    requests: DataFrame, fitted: Fitted, model: Model, key: str = "request_id", body: str = "body",
    received: str | None = None, **tag: str,
) -> DataFrame:
    """One reply per request ``key``: the predictions and probabilities of all its records in order,
    the model, and ``latency_ms`` since the time in ``received`` if that is given; or the error."""
    keep = (key,) if received is None else (key, received)
    rows = request_rows(requests.select(*keep, body), body)
    features = apply_base(rows, fitted, keep=(*keep, "pos", "error"), fill=0.0)
    scored = score(features, model, **tag)
    # a request is one message, so its records are few
    records = F.array_sort(F.collect_list(F.struct("pos", "prediction", "probability")))
    grouped = scored.groupBy(*keep, "variant", "framework", "model_key").agg(
        records.alias("records"), F.min("error").alias("error")
    )
    body_of = {"predictions": F.col("records.prediction"), "probabilities": F.col("records.probability")}
    if received is not None:
        body_of["latency_ms"] = (F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col(received))) / 1000.0
    body_of["model"] = F.struct("variant", "framework", "model_key")
    answer = F.to_json(F.struct(*[v.alias(k) for k, v in body_of.items()]))
    failed = F.to_json(F.struct("error"))
    return grouped.select(
        key, F.when(F.col("error").isNull(), F.size("records")).otherwise(0).cast("long").alias("n_predictions"), "error",
        F.when(F.col("error").isNull(), answer).otherwise(failed).alias("reply"),
    )


def evaluate(scored: DataFrame, target: str = TARGET, by: tuple[str, ...] = ("split",)) -> dict[str, DataFrame]:
    """``confusion``, ``classes``, ``summary``, ``report`` and ``loss`` tables per group.

    Rows are scored once: counts and loss sums per cell are pinned, and all tables follow from them.
    """
    matrix = pinned(metrics.confusion(scored, label=target, by=by, probability="probability"))
    classes = metrics.class_metrics(matrix, by)
    return {
        "confusion": matrix.drop("loss"),
        "classes": classes,
        "summary": metrics.summary(classes, by),
        "report": metrics.report(classes, by),
        "loss": metrics.matrix_loss(matrix, by),
    }


def compare_drift(sets: dict[str, DataFrame], model: Model, target: str = TARGET, by: tuple[str, ...] = ()) -> DataFrame:
    """One model's summary on several labelled tables, one row per table (``drift``) and group."""
    tagged = [df.withColumn("drift", F.lit(name)) for name, df in sets.items()]
    scored = score(reduce(DataFrame.unionByName, tagged), model)
    return evaluate(scored, target, ("drift", *by))["summary"]

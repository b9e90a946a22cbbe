"""Continuous scoring with the parameters and the model of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowmill.functions import messages
from flowmill.plans.features import Fitted, apply_base
from flowmill.plans.score import replies, score
from flowmill.plans.train import Model
from flowmill.streaming import events

CARRIED = ("key", "event_id", "partition", "offset")


def score_flows(flows: DataFrame, fitted: Fitted, model: Model, weekend_days: tuple[int, ...] = (5, 6), **tag: str) -> DataFrame:
    """Predictions of usable flow rows with the message key carried through; batch or stream."""
    rows = apply_base(flows, fitted, weekend_days=weekend_days, keep=CARRIED, fill=0.0)
    return score(rows, model, **tag).select(*CARRIED, "prediction", "probability", "variant", "framework", "model_key")


def features(stream: DataFrame, fitted: Fitted, weekend_days: tuple[int, ...] = (5, 6)) -> DataFrame:
    """Feature rows of a message stream: the batch transform with nulls as 0."""
    flows = messages.usable(events.decoded(stream))
    return apply_base(flows, fitted, weekend_days=weekend_days, keep=CARRIED, fill=0.0)


def scores(
    stream: DataFrame, fitted: Fitted, model: Model, weekend_days: tuple[int, ...] = (5, 6), **tag: str
) -> DataFrame:
    """Predictions with the message key carried through."""
    return score_flows(messages.usable(events.decoded(stream)), fitted, model, weekend_days, **tag)


def score_messages(scored: DataFrame) -> DataFrame:
    """Scores as ``(key, value)`` messages for the reply topic."""
    return replies(scored, ("key",)).withColumnRenamed("reply", "value")

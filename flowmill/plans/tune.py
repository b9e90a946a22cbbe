"""Random search over training parameters."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators import metrics
from flowmill.operators.sampling import cap_rows, sample_fraction
from flowmill.plans import score, train
from flowmill.sources import runs
from flowmill.sources.schemas import TARGET

Draw = Callable[[random.Random], object]


def choice(*values) -> Draw:
    return lambda rng: rng.choice(values)


def whole(low: int, high: int) -> Draw:
    """Integer in ``[low, high)``."""
    return lambda rng: rng.randrange(low, high)


def uniform(low: float, high: float) -> Draw:
    return lambda rng: rng.uniform(low, high)


def log_uniform(low: float, high: float) -> Draw:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


# fixed values: search spaces and number of trials
SPACES: dict[str, dict[str, Draw]] = {
    "trees": {
        "max_depth": whole(3, 11),
        "min_child_weight": choice(1, 2, 3),
        "subsample": uniform(0.5, 1.0),
        "eta": log_uniform(1e-4, 3e-1),
        "lambda": log_uniform(1e-3, 10.0),
        "alpha": log_uniform(1e-3, 10.0),
    },
    "net": {"batch_size": choice(64, 128, 256), "lr": log_uniform(1e-5, 1e-1), "weight_decay": log_uniform(1e-6, 1e-2)},
}
TRIALS = {"trees": 3, "net": 5}


def draw_trials(framework: str, trials: int | None = None, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    space = SPACES[framework]
    return [{k: d(rng) for k, d in space.items()} for _ in range(trials or TRIALS[framework])]


def losses(models: list[train.Model], held_out: DataFrame, target: str = TARGET) -> list[float]:
    """Mean log loss of each model, all from one pass."""
    rows = score.weigh(held_out, {f"_p{i}": m for i, m in enumerate(models)}, keep=(target,))
    found = rows.agg(*[F.avg(metrics.row_loss(target, f"_p{i}")).alias(str(i)) for i in range(len(models))]).first()
    return list(found)


def random_search(
    train_df: DataFrame, val_df: DataFrame, framework: str = "trees", key: str | None = "event_id",
    target: str = TARGET, trials: int | None = None, seed: int = 42, fraction: float | None = 0.2,
    max_train_rows: int = 0, **fixed,
) -> DataFrame:
    """One row per trial: ``run_id``, ``name`` (``mlogloss``), ``number`` and its parameters.

    Trials are trained together on one sample of the training table, ``max_train_rows`` rows at most, and
    compared on the whole validation table. ``fixed`` parameters go to every trial unchanged.
    """
    sample = cap_rows(sample_fraction(train_df, fraction, key, seed), max_train_rows, key, seed)
    sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
    drawn = draw_trials(framework, trials, seed)
    try:
        models = train.fit_many(framework, sample, [fixed | d for d in drawn], target, seed)
    finally:
        sample.unpersist()
    found = zip(drawn, losses(models, val_df, target))
    rows = [(f"{framework}-{i:03d}", "mlogloss", loss, json.dumps(params, sort_keys=True)) for i, (params, loss) in enumerate(found)]
    return train_df.sparkSession.createDataFrame(rows, "run_id string, name string, number double, params string")


def best_params(trials: DataFrame) -> dict:
    """Parameters of the trial with the smallest validation loss."""
    best = runs.best_run(trials, "mlogloss").first()["run_id"]
    return json.loads(trials.filter(F.col("run_id") == best).first()["params"])

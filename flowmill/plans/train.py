"""Distributed training over the 14 features: boosted trees and a feed-forward net."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators.validate import require_model_input
from flowmill.plans import net, trees
from flowmill.sources.schemas import FEATURES, NUM_CLASSES, TARGET

Model = trees.TreeModel | net.Net

# fixed values: default training parameters
TREE_PARAMS = {
    "eta": 0.3, "max_depth": 6, "rounds": 10, "min_child_weight": 1, "subsample": 1.0, "lambda": 1.0, "alpha": 0.0, "max_bins": 256,
}
NET_PARAMS = {"hidden": (512, 512), "dropout": 0.25, "max_epochs": 10, "batch_size": 256, "lr": 1e-3, "weight_decay": 0.0, "local_steps": 32}


def model_input(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Checked features (nulls as 0) and label of the rows that have one."""
    require_model_input(df, target)
    ready = df.fillna(0.0, subset=list(FEATURES)).withColumn("label", F.col(target).cast("double"))
    return ready.filter(F.col("label").between(0, NUM_CLASSES - 1))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if the input has fewer partitions than that. A large table has
    more and is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _ready(train: DataFrame, target: str) -> DataFrame:
    return _spread(model_input(train, target).select("label", *FEATURES))


def _merged(defaults: dict, trials: Sequence[dict]) -> list[dict]:
    unknown = sorted(set().union(*trials) - set(defaults))
    if unknown:
        raise ValueError(f"unknown parameters {unknown}; known: {sorted(defaults)}")
    return [defaults | t for t in trials]


def fit_trees(train: DataFrame, trials: Sequence[dict], target: str = TARGET, seed: int = 42) -> list[trees.TreeModel]:
    """Boosted trees with one softmax over the classes; see :func:`flowmill.plans.trees.fit`."""
    return trees.fit(_ready(train, target), FEATURES, "label", NUM_CLASSES, _merged(TREE_PARAMS, trials), seed)


def fit_net(train: DataFrame, trials: Sequence[dict], target: str = TARGET, seed: int = 42) -> list[net.Net]:
    """Feed-forward nets 14 -> hidden layers -> 6; see :func:`flowmill.plans.net.fit`."""
    return net.fit(_ready(train, target), FEATURES, "label", NUM_CLASSES, _merged(NET_PARAMS, trials), seed)


FRAMEWORKS: dict[str, Callable[..., list]] = {"trees": fit_trees, "net": fit_net}


def fit_many(framework: str, train: DataFrame, trials: Sequence[dict], target: str = TARGET, seed: int = 42) -> list[Model]:
    """One model per set of parameters, trained together: they share every pass over the table."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"unknown framework {framework!r}; known: {sorted(FRAMEWORKS)}")
    return FRAMEWORKS[framework](train, list(trials), target, seed)


def fit(framework: str, train: DataFrame, target: str = TARGET, seed: int = 42, **params) -> Model:
    return fit_many(framework, train, [params], target, seed)[0]

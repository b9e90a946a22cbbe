"""Trained models and evaluation results on storage."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from flowmill.plans.net import Net
from flowmill.plans.train import Model
from flowmill.plans.trees import Tree, TreeModel


def model_path(root: str, framework: str) -> str:
    return f"{root.rstrip('/')}/model_{framework}"


_LOADED: dict[tuple[str, str], Model] = {}


def _key(path: str) -> tuple[str, str]:
    return SparkSession.active().sparkContext.applicationId, path


def _arrays(model: Model) -> tuple[dict, dict[str, np.ndarray]]:
    """What a model consists of: a few facts and arrays by name."""
    facts = {"kind": model.kind, "features": model.features, "params": model.params}
    if isinstance(model, Net):
        return facts | {"sizes": model.sizes, "history": model.history}, {"weights": model.weights}
    arrays = {f"edges_{i}": e for i, e in enumerate(model.edges)}
    for name in ("feature", "split", "value"):
        arrays[name] = np.array([[getattr(tree, name) for tree in trees] for trees in model.trees])
    return facts | {"classes": model.classes}, arrays


def _model(facts: dict, arrays: dict[str, np.ndarray]) -> Model:
    features, params = tuple(facts["features"]), {k: tuple(v) if isinstance(v, list) else v for k, v in facts["params"].items()}
    if facts["kind"] == Net.kind:
        return Net(features, tuple(facts["sizes"]), params, arrays["weights"], facts["history"])
    trees = [[Tree(*parts) for parts in zip(*round_)] for round_ in zip(*(arrays[n] for n in ("feature", "split", "value")))]
    return TreeModel(features, [arrays[f"edges_{i}"] for i in range(len(features))], facts["classes"], params, trees)


def save_model(model: Model, root: str, framework: str) -> str:
    """A Parquet table with one row per array of the model, and its facts as JSON."""
    path = model_path(root, framework)
    facts, arrays = _arrays(model)
    rows = [("facts", json.dumps(facts), None, None)]
    rows += [(n, a.dtype.str, list(a.shape), bytearray(np.ascontiguousarray(a).tobytes())) for n, a in arrays.items()]
    table = SparkSession.active().createDataFrame(rows, "name string, text string, shape array<int>, data binary")
    table.coalesce(1).write.mode("overwrite").parquet(path)
    _LOADED.pop(_key(path), None)
    return path


def load_model(root: str, framework: str, refresh: bool = False) -> Model:
    """Model from storage; a second call in the session is served from memory unless refreshed."""
    path = model_path(root, framework)
    if refresh or _key(path) not in _LOADED:
        rows = {r["name"]: r for r in SparkSession.active().read.parquet(path).collect()}
        facts = json.loads(rows.pop("facts")["text"])
        arrays = {n: np.frombuffer(bytes(r["data"]), r["text"]).reshape(r["shape"]) for n, r in rows.items()}
        _LOADED[_key(path)] = _model(facts, arrays)
    return _LOADED[_key(path)]


def save_evaluation(root: str, run_id: str, results: dict[str, DataFrame]) -> list[str]:
    """Write ``confusion_matrix`` and ``classification_report`` tables of one run.

    Names may carry a split prefix (``val_``, ``test_``); an unprefixed name means ``val``
    and yields to ``val_*`` when both are given. Nothing is written when none is present.
    """
    written = []
    for split in ("val", "test"):
        for kind in ("confusion_matrix", "classification_report"):
            table = results.get(f"{split}_{kind}")
            if table is None and split == "val":
                table = results.get(kind)
            if table is not None:
                path = f"{root.rstrip('/')}/{kind}/run_id={run_id}/split={split}"
                table.write.mode("overwrite").parquet(path)
                written.append(path)
    return written

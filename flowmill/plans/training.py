"""The training job: tune, train, evaluate, save and log, from processed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.operators.validate import require_model_input
from flowmill.plans import score, train, tune
from flowmill.plans.train import Model
from flowmill.sources import models, parquet, runs
from flowmill.sources.schemas import NUM_CLASSES, SPLITS, TARGET


def load_splits(spark: SparkSession, processed: str, target: str = TARGET) -> dict[str, DataFrame]:
    """The three processed splits; a split without a needed column is refused before any work."""
    return {
        s: require_model_input(parquet.scan_split(spark, processed, s, schema=None), target) for s in SPLITS
    }


def _wide_metrics(tables: dict[str, DataFrame]) -> dict[str, float]:
    """Metrics of each split as ``<split>_<name>``: one row per split, one per split and class."""
    out: dict[str, float] = {}
    for row in tables["summary"].join(tables["loss"].select("split", "mlogloss", "merror"), "split").collect():
        out |= {f"{row['split']}_{k}": v for k, v in row.asDict().items() if k not in ("split", "support")}
    for row in tables["classes"].collect():
        for k in ("precision", "recall", "f1", "support"):
            out[f"{row['split']}_{k}_class_{row['class_id']}"] = row[k]
    return out


def run(
    spark: SparkSession, processed: str, output: str, framework: str = "trees", run_id: str = "run",
    search: bool = False, fraction: float | None = 0.2, trials: int | None = None, key: str | None = None,
    max_train_rows: int = 0, runs_path: str | None = None, target: str = TARGET,
    seed: int = 42, **params,
) -> tuple[Model, dict[str, float]]:
    """Train on ``train``, evaluate on ``val`` and ``test``; returns the model and its metrics.

    With ``search`` the parameters come from a random search on a sample, drawn by hashes of the unique
    column ``key`` (keep one through the split job); a row cap needs it. The model, the
    matrices and the reports go to ``output``, parameters and metrics to ``runs_path`` if given.
    """
    splits = load_splits(spark, processed, target)
    if search:
        found = tune.random_search(
            splits["train"], splits["val"], framework, key, target, trials, seed, fraction,
            max_train_rows, **params,
        )
        params = params | tune.best_params(found)
    model = train.fit(framework, splits["train"], target=target, seed=seed, **params)
    models.save_model(model, output, framework)

    held_out = [splits[s].withColumn("split", F.lit(s)) for s in ("val", "test")]
    tables = score.evaluate(score.score(held_out[0].unionByName(held_out[1]), model, framework=framework), target)
    saved = {}
    for s in ("val", "test"):
        for name, table in (("confusion_matrix", "confusion"), ("classification_report", "report")):
            saved[f"{s}_{name}"] = tables[table].filter(F.col("split") == s).drop("split")
    models.save_evaluation(output, run_id, saved)
    metrics = _wide_metrics(tables)
    common = {"target": target, "num_classes": NUM_CLASSES}
    runs.log_run(spark, runs_path, run_id, framework, common, params, metrics)
    return model, metrics

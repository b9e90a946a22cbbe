"""Quality classifier learned from positives and unlabelled text.

The risk is the non-negative unbiased one: with class prior ``p``, positives ``P`` and unlabelled
documents ``U``, it is ``p * mean_P loss(g) + max(0, mean_U loss(-g) - p * mean_P loss(-g))``; where
the last term falls below zero its gradient is followed backwards. The prior is estimated as the share
of positives among the labelled rows of the training folds. The model is linear in features of
the whole text: byte frequencies and binned statistics of characters, words and lines.

It is fitted in the driver on at most ``FIT_ROWS`` positives and ``FIT_ROWS`` unlabelled documents, the
smallest ones by a seeded hash of their ids. Everything else reads all documents.

Defined cases: a null or empty text has all features zero and gets the score that follows;
conflicting labels of one document count by the larger one, null labels not at all; a repeated
``doc_id`` is fitted once, with its smallest text, and scored per row. Without positives
or without unlabelled rows every score is the prior. A null ``doc_id`` is hashed as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import tidy

FIT_ROWS = 10_000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 250
RATE = 0.05
DECAY = 1e-4
SEED = 11
EDGES = (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
SCALARS = 9
WIDTH = 256 + SCALARS * (len(EDGES) + 2)


def text_features(texts: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` features per text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        n = max(1, len(words))
        kinds = set(words)
        letters = counts[65:91].sum() + counts[97:123].sum() + counts[195:].sum()
        ends = sum(map(text.count, (". ", "? ", ".\n"))) + 1
        scalars = (
            counts[65:91].sum() / max(1, letters),  # capitals
            1 - letters / len(raw),
            (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / len(raw),
            counts[48:58].sum() / len(raw),
            min(1.0, len(kinds) / n ** 0.75),  # variety of words
            (n - len(kinds)) / n,
            1 - len(set(lines)) / len(lines),
            min(1.0, len(raw) / n / 30),
            min(1.0, n / ends / 60),
        )
        out[i, :256] = np.sqrt(counts / len(raw))
        for k, x in enumerate(scalars):
            at = 256 + k * (len(EDGES) + 2)
            out[i, at] = x
            out[i, at + 1 + np.searchsorted(EDGES, x)] = 1
    return out


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE):
    """``(weights, bias)`` that minimise the non-negative risk with the logistic loss. The arrays are overwritten."""
    p, u = positive, unlabelled
    n = len(p) + len(u)
    mean = (p.sum(0) + u.sum(0)) / n
    for x in (p, u):  # in place: these arrays are most of the driver's memory
        x -= mean
    scale = np.sqrt((np.einsum("ij,ij->j", p, p) + np.einsum("ij,ij->j", u, u)) / n)
    scale = np.where(scale > 1e-6, scale, np.inf)  # constant features get no weight
    for x in (p, u):
        x /= scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        pull = prior * (sp - 1) / len(p)  # of the positives' own term
        push_u, push_p = su / len(u), -prior * sp / len(p)
        if negative < 0:  # only walk back the term that has gone below zero
            pull, push_u, push_p = 0 * pull, -push_u, -push_p
        dp = pull + push_p
        grad = np.append(dp @ p + push_u @ u + DECAY * w, dp.sum() + push_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w / scale, b - (mean / scale) @ w


def fold(doc_id: Column) -> Column:
    """0 to ``FOLDS - 1``; fold 0 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """``(weights, bias)``; labels of the held-out fold are never read."""
    training = fold(F.col("doc_id")) != 0
    marked = labels.filter(training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = marked.agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    if prior is None:
        return np.zeros(WIDTH), 0.0
    logit = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    ids = docs.filter(training).select("doc_id").filter("doc_id is not null").distinct()
    known = marked.filter("quality = 1").join(ids, "doc_id", "left_semi")
    chosen = (
        _smallest(known.select("doc_id"), fit_rows).withColumn("p", F.lit(1))
        .unionByName(_smallest(ids, fit_rows).withColumn("p", F.lit(0)))
        .groupBy("doc_id").agg(F.max("p").alias("positive"), F.min("p").alias("lowest"))
    )
    # at most 2 * fit_rows ids
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("positive").alias("positive"), F.min("lowest").alias("lowest")
    )
    rows = picked.mapInArrow(_sample_features, "features binary, positive int, lowest int").toPandas()
    positive, unlabelled = (
        np.array([np.frombuffer(f, "<f4") for f in rows["features"][chosen]], np.float64).reshape(int(chosen.sum()), WIDTH)
        for chosen in (rows["positive"] == 1, rows["lowest"] == 0))
    del rows
    if not len(positive) or not len(unlabelled):
        return np.zeros(WIDTH), logit
    return fit_pu(positive, unlabelled, prior)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        features = text_features(b.column("text").to_pylist())
        packed = pa.array([f.astype("<f4").tobytes() for f in features], pa.binary())
        yield pa.RecordBatch.from_arrays([packed, b.column("positive"), b.column("lowest")], ["features", "positive", "lowest"])


def with_score(docs: DataFrame, weights: np.ndarray, bias: float, into: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of ``docs`` and each text's score."""
    keep = tuple(docs.columns) if keep is None else keep
    weights = np.asarray(weights, np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(b.num_columns - 1), "")
            score = np.concatenate([
                1 / (1 + np.exp(-np.clip(text_features(texts.slice(i, 500).to_pylist()) @ weights + bias, -30, 30)))
                for i in range(0, len(texts), 500)
            ]) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], [*b.schema.names[:-1], into])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.withColumn(into, F.lit(0.0)).schema if into not in keep else None
    if schema is None:
        raise ValueError(f"column {into!r} is there already")
    for field in schema:
        field.nullable = True
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_scored")).mapInArrow(tidy(work), schema)


def report(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = with_score(docs, *fit(docs, labels, fit_rows), keep=("doc_id",))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return with_score(docs, *fit(docs, labels, fit_rows), into=name).filter(F.col(name) >= threshold).drop(name)

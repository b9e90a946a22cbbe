"""Whitening of embeddings from a covariance by polarisation.

Every entry ``c`` becomes the whole number ``x = floor(1024 c) + 100000``. With ``n`` vectors and sums ``S`` per dimension,
the exact squares ``(n x - S)^2`` are summed for each dimension, and for the sum of each pair of dimensions; since
``2 cov(a, b) = var(a + b) - var(a) - var(b)``, differences of these whole numbers give every covariance
exactly, and the first rounding is that of the matrix handed to ``eigh``.

The values are kept small without rounding: ``S = n q + r`` makes ``n x - S = n u - r`` for the small number ``u = x - q``,
and ``sum (n u - r)^2 = n^2 sum u^2 - n r^2`` because the ``u`` sum up to ``r``. The tasks sum ``u^2`` and ``(u_a + u_b)^2`` in whole
numbers. The driver gets one number per dimension and pair, however many vectors there are.

Defined cases: a vector that is null or empty or has a null or non-finite entry takes no part; neither does one
whose length is not the most frequent (of equally frequent ones the greatest). Numbers ``1024 c`` beyond ``2^62`` are held
there. Repeated rows, and null or repeated ids, count once per row. Other columns are ignored. A component
without variance has null ``whitened``, as has ``explained`` if no dimension has any; ``deviation`` is null
if it does not fit in a long; ``identity_error`` is over the components with variance, null if there is none. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAR = 1 << 62
WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: ``n`` vectors, their sums, unit axes as columns, and eigenvalues by falling size."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def varied(self) -> np.ndarray:
        """Whether a component's variance is more than rounding."""
        floor = len(self.sums) * np.finfo(float).eps * max(0.0, float(self.eigenvalues[0]))
        return self.eigenvalues > floor


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(ids, x)`` of the sound vectors of each length; the ids are the batch's first column."""
    lists = batch.column(1)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    entries = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    sizes = np.diff(bounds)
    sound = lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (wrong[bounds[1:]] == wrong[bounds[:-1]])
    for size in np.unique(sizes[sound]):
        rows = np.flatnonzero(sound & (sizes == size))
        c = entries[bounds[rows][:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c), -FAR, FAR).astype(np.int64) + SHIFT
        yield batch.column(0).take(pa.array(rows)), x


def _centred(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """``x - q`` in 64 bits, or as Python's numbers where a square of a pair's sum could pass 63 bits."""
    u = x.astype(object) - means
    return u if len(u) and max(u.max(), -u.min()) >= 1 << 29 else u.astype(np.int64)


def _moved(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    small = np.abs(x).max(initial=0) < 1 << 28 and max(map(abs, means), default=0) < 1 << 28
    return x - means.astype(np.int64) if small else _centred(x, means)


def _sum(values: np.ndarray) -> np.ndarray:
    """Exact sums down the columns, as Python's numbers."""
    if values.dtype == object:
        return values.sum(axis=0)
    low, high = (values & 0xFFFFFFFF).sum(axis=0), (values >> 32).sum(axis=0)  # a batch has fewer than 2^31 rows
    return high.astype(object) * (1 << 32) + low.astype(object)


def _rows(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    return df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """``(n, sums)`` of the vectors of the most frequent length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _vectors(batch):
                n, s = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = [n + len(x), s + _sum(x)]
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()),
                pa.array([n] * size, pa.int64()), pa.array(s.tolist(), WHOLE)], ["size", "dim", "n", "s"])

    parts = saved(rows.mapInArrow(work, "size int, dim int, n long, s decimal(38,0)"), "sums")
    sizes = parts.filter("dim = 0").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    each = parts.filter(F.col("size") == most["size"]).groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect()
    return most["n"], [int(r["s"]) for r in each]


def _squares(rows: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """``sum u_a^2`` as ``(a, a)`` and ``sum (u_a + u_b)^2`` as ``(a, b)``, added up by the cluster."""
    width, means = len(sums), np.array([s // n for s in sums], object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            for _, x in _vectors(batch):
                if x.shape[1] != width:
                    continue
                u = _moved(x, means)
                for a in range(width):
                    total[a, a] += _sum(u[:, a:a + 1] ** 2)[0]
                    total[a, a + 1:] += _sum((u[:, a:a + 1] + u[:, a + 1:]) ** 2)
        a, b = np.triu_indices(width)
        # squares of the largest numbers have more than 38 digits, so the two ends are added up apart
        high, low = zip(*(divmod(q, FAR) for q in total[a, b].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(high, WHOLE), pa.array(low, WHOLE)], ["a", "b", "h", "l"])

    parts = rows.mapInArrow(work, "a int, b int, h decimal(38,0), l decimal(38,0)")
    added = parts.groupBy("a", "b").agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
    return {(r["a"], r["b"]): int(r["h"]) * FAR + int(r["l"]) for r in added.toLocalIterator()}


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances (divisor ``n``) from squares of dimensions and of pair sums, each rounded once."""
    rest = [s % n for s in sums]
    var = {(a, b): n * n * q - n * (rest[a] + (rest[b] if a != b else 0)) ** 2 for (a, b), q in squares.items()}
    out = np.empty((len(sums), len(sums)))
    for (a, b), v in var.items():
        out[a, b] = out[b, a] = v / n ** 3 if a == b else (v - var[a, a] - var[b, b]) / (2 * n ** 3)
    return out


def fit(df: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """The first ``components`` principal axes; None without vectors."""
    rows = _rows(df, id_column, vector)
    n, sums = _sums(rows)
    if not n:
        return None
    cov = covariance(n, sums, _squares(rows, n, sums))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    largest = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), np.ascontiguousarray(axes), values, float(np.trace(cov)))


def _projected(x: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """``(u, whitened)``; components without variance come out as nan."""
    n = fitted.n
    u = _moved(x, np.array([s // n for s in fitted.sums], object))
    centred = u.astype(np.float64) - np.array([(s % n) / n for s in fitted.sums])
    scale = np.sqrt(np.where(fitted.varied, fitted.eigenvalues, np.nan))
    return u, centred @ fitted.axes / scale


def _deviation(u: np.ndarray, fitted: Whitening) -> list[int | None]:
    """``sum (n u - r)^2`` of each row, exactly."""
    n, rest = fitted.n, np.array([s % fitted.n for s in fitted.sums], object)
    bound = n * (int(max(u.max(initial=0), -u.min(initial=0))) + 1)
    if bound * bound * u.shape[1] < 1 << 63:
        return ((n * u - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * u.astype(object) - rest) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(df: DataFrame, fitted: Whitening, id_column: str = "vec_id", vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    width, kept = len(fitted.sums), np.flatnonzero(fitted.varied)
    if not len(kept):
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept) + 1, len(kept)))
        for batch in batches:
            for _, x in _vectors(batch):
                if x.shape[1] == width:
                    w = _projected(x, fitted)[1][:, kept]
                    total += np.vstack((w.T @ w, w.sum(axis=0)))
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())], ["a", "b", "v"])

    # x - S / n has mean zero, so these products are centred ones; the sums tell how far rounding has moved the mean
    added = _rows(df, id_column, vector).mapInArrow(work, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    total = np.zeros((len(kept) + 1, len(kept)))
    for r in added.collect():
        total[r["a"], r["b"]] = r["v"] / fitted.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(kept))).max())


def transform(df: DataFrame, fitted: Whitening, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(<id>, deviation, whitened)``, one row per sound vector; ``whitened`` is an array over the components."""
    width, count = len(fitted.sums), len(fitted.eigenvalues)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _vectors(batch):
                if x.shape[1] == width:
                    u, w = _projected(x, fitted)
                    flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * count, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(_deviation(u, fitted), pa.int64()), lists], [id_column, "deviation", "whitened"])

    return _rows(df, id_column, vector).mapInArrow(work, f"`{id_column}` long, deviation long, whitened array<double>")


def report(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component."""
    fitted = fit(df, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, fitted)
    shares = [float(e) / fitted.trace if fitted.trace > 0 else None for e in fitted.eigenvalues]
    rows = transform(df, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in shares]), "pos").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

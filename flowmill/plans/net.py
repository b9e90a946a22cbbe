"""A feed-forward net trained on all partitions at once.

Layers are linear with ReLU and dropout between them; the loss is cross-entropy, the optimizer Adam with weight
decay added to the gradient. Training goes in rounds. In a round each part of the table takes the weights and moments
as they are, makes ``local_steps`` steps on mini-batches of its own rows, and gives back what has come of them; the average over
the parts, weighted by rows, is where the next round begins. With one step a round is a step on
averaged updates; more steps send the weights less often. An epoch has as many rounds as the largest part needs.

The order of rows, dropout and the first weights come from seeds, and averages are added up in the order of the parts,
so a second run on the same table gives the same net. Averages are taken slice by slice of the weights in as many
tasks, and the driver gets one set of weights a round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.plans.trees import softmax
from flowmill.sources.session import discard, pinned_at

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
SLICE = 1 << 16  # numbers of one slice of the weights
PART_ROWS = 1 << 16  # rows of a part at most, so that one fits in memory


@dataclass
class Net:
    """Weights of all layers in one vector: for each layer ``(inputs, outputs)`` row by row, then its offsets."""

    features: tuple[str, ...]
    sizes: tuple[int, ...]
    params: dict
    weights: np.ndarray
    history: list[float] = field(default_factory=list)  # mean loss of each epoch

    kind = "net"

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities ``(rows, classes)`` of a ``(rows, features)`` array, without dropout."""
        out = np.empty((len(x), self.sizes[-1]))
        layers = _layers(self.weights, self.sizes)
        for i in range(0, len(x), 4096):
            a = x[i:i + 4096].astype(np.float32)
            for j, (w, b) in enumerate(layers):
                a = a @ w + b
                if j + 1 < len(layers):
                    a = np.maximum(a, 0)
            out[i:i + 4096] = softmax(a.T).T
        return out


def _count(sizes: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(sizes, sizes[1:]))


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's matrix and offsets."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-a ** -0.5, a ** -0.5, a * b + b) for a, b in zip(sizes, sizes[1:])]).astype(np.float32)


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, dropout: float = 0.0,
                      rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a mini-batch and its gradient by backpropagation."""
    layers, inputs, masks, a = _layers(weights, sizes), [], [], x
    for j, (w, b) in enumerate(layers):
        inputs.append(a)
        a = a @ w + b
        if j + 1 < len(layers):
            mask = a > 0
            if dropout:
                mask = mask * ((rng.random(a.shape, np.float32) >= dropout) / np.float32(1 - dropout)).astype(a.dtype)
            masks.append(mask)
            a = a * mask
    p = softmax(a.T).T
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).mean())
    p[rows, y] -= 1
    back = (p / len(y)).astype(weights.dtype)
    grad = np.empty_like(weights)
    for j, ((gw, gb), (w, _)) in reversed(list(enumerate(zip(_layers(grad, sizes), layers)))):
        gw[:] = inputs[j].T @ back
        gb[:] = back.sum(axis=0)
        if j:
            back = (back @ w.T) * masks[j - 1]
    return loss, grad


def _adam(state: np.ndarray, grad: np.ndarray, step: int, params: dict) -> None:
    """One step in place; ``state`` holds weights, mean and mean square of gradients."""
    w, m, v = state
    grad = grad + np.float32(params["weight_decay"]) * w
    m += np.float32(1 - BETA1) * (grad - m)
    v += np.float32(1 - BETA2) * (grad * grad - v)
    root = np.sqrt(v / np.float32(1 - BETA2 ** step)) + np.float32(EPSILON)
    w -= np.float32(params["lr"] / (1 - BETA1 ** step)) * m / root


def _parts(rows: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, str]:
    """Numbered parts of at most ``PART_ROWS`` rows, as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, n = [], [], 0

        def part():
            x, y = np.concatenate(xs), np.concatenate(ys)
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["n", "x", "y"])

        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                piece = batch.slice(at, PART_ROWS)
                if n + piece.num_rows > PART_ROWS:
                    yield part()
                    xs, ys, n = [], [], 0
                xs.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in piece.columns[1:]]).astype("<f4"))
                ys.append(piece.column(0).to_numpy().astype("u1"))
                n += piece.num_rows
        if n:
            yield part()

    each = rows.select(F.col(label).cast("int"), *[F.col(f).cast("double") for f in features])
    packed = each.mapInArrow(pack, "n long, x binary, y binary")
    # the number only seeds and orders; it is written down, so it stays what it is
    return pinned_at(packed.withColumn("part", F.monotonically_increasing_id()), "parts")


def _round(parts: DataFrame, states: list[np.ndarray], nets: list[Net], epoch: int, round_: int, local_steps: int, done: list[int],
           seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The averaged state of each net after a round, and rows and summed loss of each: ``(nets, 2)``."""
    sizes, params = nets[0].sizes, [n.params for n in nets]
    width = states[0].shape[1]
    # whole states go to the workers once per round, not once per task
    sent = parts.sparkSession.sparkContext.broadcast([s.tobytes() for s in states])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y = np.frombuffer(row["y"], "u1").astype(np.int64)
                x = np.frombuffer(row["x"], "<f4").reshape(len(y), -1)
                order = np.random.default_rng([seed, epoch, row["part"]]).permutation(len(y))
                for t, p in enumerate(params):
                    if epoch >= p["max_epochs"]:
                        continue
                    state = np.frombuffer(sent.value[t], np.float32).reshape(3, width).copy()
                    rng = np.random.default_rng([seed, epoch, round_, row["part"], t])
                    used, loss, first = 0, 0.0, round_ * local_steps * p["batch_size"]
                    for step in range(local_steps):
                        mine = order[first + step * p["batch_size"]:first + (step + 1) * p["batch_size"]]
                        if not len(mine):
                            break
                        value, grad = loss_and_gradient(state[0], sizes, x[mine], y[mine], p["dropout"], rng)
                        _adam(state, grad, done[t] + step + 1, p)
                        used, loss = used + len(mine), loss + value * len(mine)
                    if not used:
                        continue
                    flat = state.reshape(-1)
                    cuts = range(0, len(flat), SLICE)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([t] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()), pa.array([row["part"]] * len(cuts), pa.int64()),
                        pa.array([used] * len(cuts), pa.int64()), pa.array([loss] * len(cuts)), pa.array([flat[c:c + SLICE].tobytes() for c in cuts], pa.binary()),
                    ], ["trial", "slice", "part", "n", "loss", "state"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n, loss = None, None, 0, 0.0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]),
                                               pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["trial", "slice", "n", "loss", "state"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["trial"], r["slice"]) != key:
                    if key is not None:
                        yield row()
                    key, total, n, loss = (r["trial"], r["slice"]), 0.0, 0, 0.0
                total = total + np.frombuffer(r["state"], np.float32).astype(np.float64) * r["n"]
                n, loss = n + r["n"], loss + r["loss"]
        if key is not None:
            yield row()

    trained = parts.mapInArrow(work, "trial int, slice int, part long, n long, loss double, state binary")
    slices = -(-3 * width // SLICE) * len(nets)
    dealt = trained.repartition(min(slices, parts.sparkSession.sparkContext.defaultParallelism), "trial", "slice")
    found = dealt.sortWithinPartitions("trial", "slice", "part").mapInArrow(average, "trial int, slice int, n long, loss double, state binary").collect()
    sent.destroy()
    out, sums = [s.copy() for s in states], np.zeros((len(nets), 2))
    for r in found:
        values = np.frombuffer(r["state"], np.float32)
        out[r["trial"]].reshape(-1)[r["slice"] * SLICE:r["slice"] * SLICE + len(values)] = values
        sums[r["trial"]] = r["n"], r["loss"]
    return out, sums


def fit(rows: DataFrame, features: Sequence[str], label: str, classes: int, trials: Sequence[dict], seed: int = 42) -> list[Net]:
    """A net for each trial's parameters, all trained on one table in the same rounds.

    ``rows`` has numbers without nulls in ``features`` and classes from 0 in ``label``. Parameters: ``hidden``, ``dropout``, ``batch_size``,
    ``max_epochs``, ``lr``, ``weight_decay`` and, alike in all trials, ``hidden`` and ``local_steps``. Without rows the first weights stay.
    """
    if len({(tuple(t["hidden"]), t["local_steps"]) for t in trials}) > 1:
        raise ValueError("trials share their layers and local steps")
    sizes = (len(features), *trials[0]["hidden"], classes)
    nets = [Net(tuple(features), sizes, dict(t), first_weights(sizes, seed)) for t in trials]
    parts, path = _parts(rows, features, label)
    largest = parts.agg(F.max("n")).first()[0] or 0
    states = [np.stack((n.weights, np.zeros_like(n.weights), np.zeros_like(n.weights))) for n in nets]
    done, steps = [0] * len(nets), trials[0]["local_steps"]
    for epoch in range(max(t["max_epochs"] for t in trials) if largest else 0):
        sums, smallest = np.zeros((len(nets), 2)), min(t["batch_size"] for t in trials if epoch < t["max_epochs"])
        for round_ in range(-(-largest // (smallest * steps))):
            states, found = _round(parts, states, nets, epoch, round_, steps, done, seed)
            sums += found
            done = [d + steps * (n > 0) for d, (n, _) in zip(done, found)]
        for net, (n, loss) in zip(nets, sums):
            if n:
                net.history.append(loss / n)
    for net, state in zip(nets, states):
        net.weights = state[0].copy()
    discard(rows.sparkSession, path)
    return nets

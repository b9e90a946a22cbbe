"""Gradient-boosted trees of several classes from histograms of gradients.

Features are cut into bins once; what is kept of a row is one byte per feature, its label and its margins. Each
pass over that table sums gradients and second derivatives per (trial, class, node, feature, bin) inside
the tasks; a grouped sum merges them, and the same task that holds a node's sums picks its best split. The
driver sees one row per node. All classes of a round, and all trials of a search, share the passes.

Gradients are summed as whole numbers (multiples of 2^-24), so that sums, splits and models do not depend on how
rows are dealt out to tasks, and a second run gives the same model.

The objective is softmax over the ``C`` classes with ``g = p - y`` and ``h = C / (C - 1) p (1 - p)``, as usual where each class
has its own tree. A node of sums ``G`` and ``H`` scores
``T(G)^2 / (H + lambda)``, with ``T`` moving ``G`` towards 0 by ``alpha``; its weight is ``-eta T(G) / (H + lambda)``. A split
must raise the score and leave ``min_child_weight`` of ``H`` on both sides; of equal ones that of the first feature
and the smallest value is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.sources.session import discard, pinned, pinned_at

UNIT = 1 << 24  # gradients are multiples of 1 / UNIT
LEAST_GAIN = 1e-6
LEAST_HESSIAN = 1e-16
BLOCK_ROWS = 1 << 16
PASS_BYTES = 128 << 20  # sums that one task may hold; more nodes take another pass
KEY_BITS = 24  # leading bits by which values are counted for the bins
BLOCK = "n long, bins binary, label binary, draw binary, margin binary"


@dataclass
class Tree:
    """Nodes in heap order (children of ``i`` are ``2 i + 1`` and ``2 i + 2``); a leaf has feature -1."""

    feature: np.ndarray
    split: np.ndarray  # the last bin that goes left
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.float32))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each column of ``bins`` after ``depth`` steps."""
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(depth):
            f = self.feature[node]
            step = 2 * node + 1 + (bins[f, rows] > self.split[node])
            node = np.where(f >= 0, step, node)
        return node


@dataclass
class TreeModel:
    """A boosted ensemble; ``trees[round][class]``. ``predict`` needs nothing but numpy."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    classes: int
    params: dict
    trees: list[list[Tree]] = field(default_factory=list)

    kind = "trees"

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.zeros((self.classes, len(x)), np.float32)
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[k] += tree.value[tree.leaves(bins, self.params["max_depth"])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities ``(rows, classes)`` of a ``(rows, features)`` array."""
        return softmax(self.margins(x)).T

    def table(self) -> list[tuple]:
        """``(round, class, node, feature, value below which rows go left, weight)`` of every used node."""
        rows = []
        for r, trees in enumerate(self.trees):
            for k, tree in enumerate(trees):
                reached = [0]
                for i in reached:
                    f = int(tree.feature[i])
                    if f >= 0:
                        reached += [2 * i + 1, 2 * i + 2]
                        rows.append((r, k, i, self.features[f], float(self.edges[f][tree.split[i]]), None))
                    else:
                        rows.append((r, k, i, None, None, float(tree.value[i])))
        return rows


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers ``(features, rows)``: how many edges are at most the value."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16
    return np.stack([np.searchsorted(e, x[:, f], "right").astype(kind) for f, e in enumerate(edges)])


def softmax(margin: np.ndarray) -> np.ndarray:
    """Down the first axis, in doubles."""
    e = np.exp(margin.astype(np.float64) - margin.max(axis=0))
    return e / e.sum(axis=0)


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(g, h)`` of shape ``(classes, rows)`` in whole multiples of ``1 / UNIT``."""
    p = softmax(margin)
    y = np.arange(len(p))[:, None] == label
    spread = len(p) / max(1, len(p) - 1) * p * (1 - p)
    return np.rint((p - y) * UNIT), np.rint(np.maximum(spread, LEAST_HESSIAN) * UNIT)


def _score(g: np.ndarray, h: np.ndarray, params: dict) -> np.ndarray:
    left = np.sign(g) * np.maximum(np.abs(g) - params["alpha"], 0.0)
    return left * left / np.maximum(h + params["lambda"], 1e-300)


def weight(g: float, h: float, params: dict) -> float:
    left = np.sign(g) * max(abs(g) - params["alpha"], 0.0)
    return float(-params["eta"] * left / max(h + params["lambda"], 1e-300))


def best_split(sums: np.ndarray, params: dict) -> tuple[int, int, float, int, int] | None:
    """``(feature, bin, gain, g left, h left)`` of whole-number sums ``(2, features, bins)``, or None for a leaf."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    gl, hl = left / UNIT
    g, h = total / UNIT
    gr, hr = (total[:, None, None] - left) / UNIT
    gain = _score(gl, hl, params) + _score(gr, hr, params) - _score(g, h, params)
    gain[(hl < params["min_child_weight"]) | (hr < params["min_child_weight"])] = -np.inf
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > LEAST_GAIN:
        return None
    return int(f), int(b), float(gain[f, b]), int(left[0, f, b]), int(left[1, f, b])


# ---- bins -------------------------------------------------------------------------------------------------


def _order_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles ``x``."""
    raw = (x + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)


def bin_edges(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """At most ``max_bins - 1`` edges per feature, near its quantiles.

    Rows are counted by the leading bits of their values, with the smallest and largest value of each such group; the
    counts are whole numbers, so the edges do not depend on the order of rows. An edge lies half way between two
    neighbouring groups. Features of fewer groups than bins get all such edges.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in range(batch.num_columns):
                x = batch.column(f).to_numpy(zero_copy_only=False)
                group, first, n = np.unique(_order_bits(x) >> (64 - KEY_BITS), return_inverse=True, return_counts=True)
                least, most = np.full(len(group), np.inf), np.full(len(group), -np.inf)
                np.minimum.at(least, first, x)
                np.maximum.at(most, first, x)
                columns = [pa.array([f] * len(group), pa.int32()), pa.array(group), pa.array(n), pa.array(least), pa.array(most)]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "part", "n", "least", "most"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, before, taken, last = -1, 0, 0, 0.0
        for batch in batches:
            out = []
            for f, n, least, most, total, groups in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if f != feature:
                    feature, before, taken = f, 0, 0
                due = before if groups <= max_bins else before * max_bins // total
                if before and (groups <= max_bins or due > taken):
                    middle = last / 2 + least / 2
                    out.append((f, middle if last < middle else least))
                    taken = due
                before, last = before + n, most
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64())], ["feature", "edge"])

    parts = rows.select(*[F.col(f).cast("double") for f in features]).mapInArrow(count, "feature int, part long, n long, least double, most double")
    groups = pinned(parts.groupBy("feature", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")), "bins")
    sizes = groups.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"))  # one row per feature
    listed = groups.join(F.broadcast(sizes), "feature").repartition("feature").sortWithinPartitions("feature", "part")
    found = listed.select("feature", "n", "least", "most", "total", "groups").mapInArrow(choose, "feature int, edge double").collect()
    return [np.array(sorted(r["edge"] for r in found if r["feature"] == f)) for f in range(len(features))]


def _blocks(rows: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray], trials: int, classes: int,
            draw: bool) -> tuple[DataFrame, str]:
    """The table that is trained on: a row holds the bins, labels and margins of many rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[2:]])
                columns = (binned(x, edges), part.column(0).to_numpy().astype(np.uint8),
                           part.column(1).to_numpy() if draw else np.zeros(0, np.int64), np.zeros((trials, classes, len(x)), np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["n", "bins", "label", "draw", "margin"])

    doubles = [F.col(f).cast("double") for f in features]
    each = rows.select(F.col(label).cast("int"), F.xxhash64(*doubles, F.col(label).cast("double")).alias("draw"), *doubles)
    return pinned_at(each.mapInArrow(pack, BLOCK), "blocks")


def _unpacked(batches: Iterator[pa.RecordBatch], features: int, wide: bool, trials: int, classes: int):
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            yield (np.frombuffer(row["bins"], np.uint16 if wide else np.uint8).reshape(features, n), np.frombuffer(row["label"], np.uint8),
                   np.frombuffer(row["draw"], np.int64), np.frombuffer(row["margin"], np.float32).reshape(trials, classes, n), row)


def _drawn(draw: np.ndarray, trial: int, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether a row is in a round's sample, by a hash of the row."""
    x = draw.view(np.uint64) ^ np.uint64((seed * 1_000_003 + trial * 7919 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


# ---- passes -----------------------------------------------------------------------------------------------

Node = tuple[int, int, int]  # trial, class, place in the heap


def _level(blocks: DataFrame, models: list[TreeModel], growing: list[list[Tree]], nodes: list[Node], depth: int, bins: int,
           round_: int, seed: int) -> dict[Node, tuple]:
    """``(g, h, best split or None)`` of each open node, all of them ``depth`` steps below the root."""
    first = models[0]
    width, wide = len(first.features), bins > 256
    params = [m.params for m in models]
    places: dict[tuple[int, int], list[int]] = {}
    for t, k, i in nodes:
        places.setdefault((t, k), []).append(i)
    step = max(1, PASS_BYTES // (16 * width * bins))
    if len(nodes) > step:  # more sums than a task may hold
        out: dict[Node, tuple] = {}
        for i in range(0, len(nodes), step):
            out |= _level(blocks, models, growing, nodes[i:i + step], depth, bins, round_, seed)
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros((2, width, len(at) * bins), np.int64) for key, at in places.items()}
        for x, label, draw, margin, _ in _unpacked(batches, width, wide, len(params), first.classes):
            for t, p in enumerate(params):
                if not any(key[0] == t for key in places):
                    continue
                g, h = gradients(margin[t], label)
                chosen = _drawn(draw, t, round_, seed, p["subsample"]) if p["subsample"] < 1 else None
                for k in range(first.classes):
                    at = places.get((t, k))
                    if at is None:
                        continue
                    slot = np.full(1 << (depth + 1), -1, np.int64)
                    slot[at] = np.arange(len(at))
                    mine = slot[growing[t][k].leaves(x, depth)]
                    here = mine >= 0 if chosen is None else (mine >= 0) & chosen
                    every = here.all()
                    base = (mine if every else mine[here]) * bins
                    gk, hk = (g[k], h[k]) if every else (g[k][here], h[k][here])
                    for f in range(width):
                        cell = base + (x[f] if every else x[f][here])
                        into = sums[t, k][:, f]
                        # a block's sums of whole numbers stay far below 2^53, so these are exact
                        into[0] += np.bincount(cell, gk, into.shape[1]).astype(np.int64)
                        into[1] += np.bincount(cell, hk, into.shape[1]).astype(np.int64)
        for (t, k), found in sums.items():
            at = places[t, k]
            each = found.reshape(2, width, len(at), bins).transpose(2, 0, 1, 3)
            yield pa.RecordBatch.from_arrays([
                pa.array([t] * len(at), pa.int32()), pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()),
                pa.array([s.tobytes() for s in each], pa.binary())], ["trial", "class", "node", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Node, np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, raw in zip(keys, batch.column(3)):
                part = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, width, bins)
                total[key] = total[key] + part if key in total else part
        rows = []
        for (t, k, i), sums in total.items():
            g, h = sums[:, 0].sum(axis=1).tolist()
            rows.append((t, k, i, g, h, *(best_split(sums, params[t]) or (None,) * 5)))
        if rows:
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list("tkighfbwlm"))

    parts = min(len(nodes), blocks.sparkSession.sparkContext.defaultParallelism)
    added = blocks.mapInArrow(add, "trial int, class int, node int, sums binary").repartition(parts, "trial", "class", "node")
    best = added.mapInArrow(choose, "t int, k int, i int, g long, h long, f int, b int, w double, l long, m long").collect()
    return {(r["t"], r["k"], r["i"]): (r["g"], r["h"], None if r["f"] is None else (r["f"], r["b"], r["w"], r["l"], r["m"])) for r in best}


def _grow(blocks: DataFrame, models: list[TreeModel], bins: int, round_: int, seed: int) -> list[list[Tree]]:
    """One round: a tree for every trial and class."""
    growing = [[Tree.empty(m.params["max_depth"]) for _ in range(m.classes)] for m in models]
    nodes = [(t, k, 0) for t, m in enumerate(models) for k in range(m.classes) if round_ < m.params["rounds"]]
    for depth in range(max(m.params["max_depth"] for m in models)):
        nodes = [n for n in nodes if depth < models[n[0]].params["max_depth"]]
        if not nodes:
            break
        found, nodes = _level(blocks, models, growing, nodes, depth, bins, round_, seed), []
        for (t, k, i), (g, h, split) in sorted(found.items()):
            tree, params = growing[t][k], models[t].params
            if i == 0:
                tree.value[0] = weight(g / UNIT, h / UNIT, params)
            if split is not None:
                f, b, _, gl, hl = split
                tree.feature[i], tree.split[i] = f, b
                tree.value[2 * i + 1] = weight(gl / UNIT, hl / UNIT, params)
                tree.value[2 * i + 2] = weight((g - gl) / UNIT, (h - hl) / UNIT, params)
                nodes += [(t, k, 2 * i + 1), (t, k, 2 * i + 2)]
    return growing


def _updated(blocks: DataFrame, models: list[TreeModel], grown: list[list[Tree]], wide: bool) -> tuple[DataFrame, str]:
    """The table with the margins after a round."""
    width, classes, depths = len(models[0].features), models[0].classes, [m.params["max_depth"] for m in models]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, margin, row in _unpacked(batches, width, wide, len(depths), classes):
            margin = margin.copy()
            for t, trees in enumerate(grown):
                for k, tree in enumerate(trees):
                    margin[t, k] += tree.value[tree.leaves(x, depths[t])]
            row["margin"] = margin.tobytes()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("n", pa.int64()), ("bins", pa.binary()), ("label", pa.binary()), ("draw", pa.binary()), ("margin", pa.binary())]))

    return pinned_at(blocks.mapInArrow(update, BLOCK), "blocks")


def fit(rows: DataFrame, features: Sequence[str], label: str, classes: int, trials: Sequence[dict], seed: int = 42) -> list[TreeModel]:
    """A model for each trial's parameters, all of them from the same passes over one table of bins.

    ``rows`` has numbers without nulls in ``features`` and classes from 0 in ``label``. Parameters: ``eta``, ``max_depth``, ``rounds``,
    ``min_child_weight``, ``subsample``, ``lambda``, ``alpha`` and, alike in all trials, ``max_bins``. Samples of rows are drawn by
    a hash of their values, so rows that are alike are drawn together. Without rows every class is equally likely.
    """
    most = max(t["max_bins"] for t in trials)
    if most > 1 << 16:
        raise ValueError("at most 65536 bins")
    edges = bin_edges(rows, features, most)
    bins = max(map(len, edges), default=0) + 1
    models = [TreeModel(tuple(features), edges, classes, dict(t)) for t in trials]
    if bins == 1:
        return models
    blocks, path = _blocks(rows, features, label, edges, len(models), classes, any(t["subsample"] < 1 for t in trials))
    rounds = max(t["rounds"] for t in trials)
    for r in range(rounds):
        grown = _grow(blocks, models, bins, r, seed)
        for model, trees in zip(models, grown):
            if r < model.params["rounds"]:
                model.trees.append(trees)
        if r + 1 < rounds:
            before = path
            blocks, path = _updated(blocks, models, grown, bins > 256)
            discard(rows.sparkSession, before)
    discard(rows.sparkSession, path)
    return models

"""Models as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.plans.net import Net
from flowmill.plans.trees import TreeModel


def weights(model: TreeModel | Net, wanted: Column | None = None) -> Column:
    """One non-negative number per class, as an array; null where ``wanted`` is not true.

    Rows that are not wanted cost nothing.
    """
    if isinstance(model, TreeModel):
        column = _tree_weights(model, wanted)
        return column if wanted is None else F.when(wanted, column)
    row = F.struct(*[F.col(f"`{f}`").cast("double") for f in model.features])
    return _net_weights(model)(row if wanted is None else F.when(wanted, row))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _flat(model: TreeModel) -> tuple[list[list], list[list[int]], int]:
    """Feature, split value, left child and weight of all nodes in one list each; the roots of each class; the depth.

    A right child follows its left one. A leaf leads to itself: no value reaches its split.
    """
    nodes, roots, depth = [], [[] for _ in range(model.classes)], 0
    for trees in model.trees:
        for k, tree in enumerate(trees):
            first, todo = len(nodes), [(0, 0)]
            roots[k].append(first)
            for heap, level in todo:
                depth = max(depth, level)
                f = int(tree.feature[heap])
                if f < 0:
                    nodes.append((0, float("inf"), len(nodes), float(tree.value[heap])))
                else:
                    nodes.append((f, float(model.edges[f][tree.split[heap]]), first + len(todo), 0.0))
                    todo += [(2 * heap + 1, level + 1), (2 * heap + 2, level + 1)]
    return [list(c) for c in zip(*nodes)], roots, depth


def _tree_weights(model: TreeModel, wanted: Column | None = None) -> Column:
    """Probabilities from the margins of all trees, which are walked once per Arrow batch."""
    if not model.trees:
        return F.array_repeat(F.lit(1.0 / model.classes), model.classes)
    row = F.struct(*[F.col(f"`{f}`").cast("double") for f in model.features])
    margins = _tree_margins(model)(row if wanted is None else F.when(wanted, row))
    powers = _let(margins, lambda m: _let(F.array_max(m), lambda most: F.transform(m, lambda v: F.exp(v - most))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return _let(powers, lambda e: _let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def _literal(values: list, kind: str) -> Column:
    """An array that is one constant after planning, however long."""
    return F.from_json(F.lit(json.dumps(values).replace("Infinity", '"Infinity"')), f"array<{kind}>")


def _tree_margins(model: TreeModel):
    """Each class's margin of a row, as Spark's array look-ups found it: a row goes right where its value is at least the
    split (NaN above all), a null value or a node past the last makes the class's margin null, and a class's trees are
    added up in single precision, in order, as in training."""
    columns, roots, depth = _flat(model)
    feature, left = np.array(columns[0], np.int64), np.array(columns[2], np.int64)
    split, value = np.array(columns[1], np.float64), np.array(columns[3], np.float32)

    @F.arrow_udf("array<double>")
    def margins(rows: pa.Array) -> pa.Array:
        here = rows.is_valid().to_numpy(zero_copy_only=False)
        n, at = len(rows), np.arange(len(rows))
        x = np.column_stack([rows.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(model.features))])
        null = np.column_stack([rows.field(i).is_null().to_numpy(zero_copy_only=False) for i in range(len(model.features))])
        out, lost = np.zeros((n, model.classes), np.float32), np.zeros((n, model.classes), bool)
        for k, of_class in enumerate(roots):
            for root in of_class:
                node, gone = np.full(n, root, np.int64), lost[:, k].copy()
                for _ in range(depth):
                    v = x[at, feature[node]]
                    gone |= null[at, feature[node]]
                    node = left[node] + ((v >= split[node]) | np.isnan(v))
                    past = node >= len(left)
                    gone |= past
                    node[past] = 0
                out[:, k] = np.where(gone, out[:, k], out[:, k] + value[node])
                lost[:, k] = gone
        ends = np.concatenate(([0], np.cumsum(here))) * model.classes
        values = pa.array(out[here].astype(np.float64).ravel(), mask=lost[here].ravel())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return lists if here.all() else pa.array([v if h else None for v, h in zip(lists.to_pylist(), here)], pa.list_(pa.float64()))

    return margins


def _net_weights(net: Net):
    @F.arrow_udf("array<double>")
    def predict(rows: pa.Array) -> pa.Array:
        here = rows.is_valid().to_numpy(zero_copy_only=False)
        x = np.column_stack([rows.field(i).to_numpy(zero_copy_only=False)[here] for i in range(len(net.features))])
        p = net.predict(x)
        ends = np.concatenate(([0], np.cumsum(here))) * p.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p.ravel()))
        return lists if here.all() else pa.array([v if h else None for v, h in zip(lists.to_pylist(), here)], pa.list_(pa.float64()))

    return predict

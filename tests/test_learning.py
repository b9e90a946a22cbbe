"""Trees and nets against plain versions of their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.plans import net, predict, train, trees
from flowmill.sources import models as stored

FEATURES = ("a", "b", "c", "d")
PARAMS = train.TREE_PARAMS | {"rounds": 3, "max_depth": 3, "lambda": 0.7, "alpha": 0.4, "min_child_weight": 3, "eta": 0.4, "max_bins": 32}
NET = train.NET_PARAMS | {"hidden": (9, 7), "max_epochs": 4, "batch_size": 16, "local_steps": 2, "lr": 0.01, "weight_decay": 0.01}


def numbers(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 5, n), rng.normal(size=n).round(2), rng.integers(0, 2, n), np.exp(rng.normal(size=n))]).astype(float)
    y = (x[:, 0] + 2 * x[:, 2] + (x[:, 1] > 0.3)).astype(int) % 4
    return x, np.where(rng.random(n) < 0.1, rng.integers(0, 4, n), y)


def table(spark, x, y, parts=7):
    rows = [(*map(float, v), int(k)) for v, k in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label int").repartition(parts)


@pytest.fixture(scope="module")
def data(spark):
    x, y = numbers()
    return x, y, table(spark, x, y).cache()


# ---- trees ----------------------------------------------------------------------

def plain_trees(x, y, edges, classes, p):
    """Boosting row by row and threshold by threshold; returns probabilities."""
    shrink = lambda g: np.sign(g) * max(abs(g) - p["alpha"], 0.0)
    score = lambda g, h: shrink(g) ** 2 / (h + p["lambda"])
    margin = np.zeros((len(x), classes), np.float32)
    for _ in range(p["rounds"]):
        e = np.exp(margin.astype(float) - margin.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(margin)
        for k in range(classes):
            g = np.rint((prob[:, k] - (y == k)) * trees.UNIT)
            h = np.rint(classes / (classes - 1) * prob[:, k] * (1 - prob[:, k]) * trees.UNIT)

            def grow(rows, depth):
                gs, hs = g[rows].sum() / trees.UNIT, h[rows].sum() / trees.UNIT
                best = None
                for f in range(x.shape[1]) if depth < p["max_depth"] else ():
                    for cut in edges[f]:
                        low = rows[x[rows, f] < cut]
                        gl, hl = g[low].sum() / trees.UNIT, h[low].sum() / trees.UNIT
                        if hl < p["min_child_weight"] or hs - hl < p["min_child_weight"]:
                            continue
                        gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                        if best is None or gain > best[0]:
                            best = gain, f, cut
                if best is None or best[0] <= trees.LEAST_GAIN:
                    step[rows, k] = np.float32(-p["eta"] * shrink(gs) / (hs + p["lambda"]))
                else:
                    left = x[rows, best[1]] < best[2]
                    grow(rows[left], depth + 1)
                    grow(rows[~left], depth + 1)

            grow(np.arange(len(x)), 0)
        margin += step
    e = np.exp(margin.astype(float) - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def model(data):
    return trees.fit(data[2], FEATURES, "label", 4, [PARAMS])[0]


def test_trees_equal_the_plain_version(data, model):
    x, y, _ = data
    assert np.allclose(model.predict(x), plain_trees(x, y, model.edges, 4, PARAMS), atol=1e-9)
    assert (model.predict(x).argmax(axis=1) == y).mean() > 0.6


def test_scores_in_the_engine_are_the_models(data, model, spark):
    x, _, df = data
    got = {tuple(r[:4]): r["p"] for r in df.select(*FEATURES, predict.weights(model).alias("p")).collect()}
    assert np.allclose([got[tuple(v)] for v in x], model.predict(x), atol=1e-12)
    part = df.select("a", predict.weights(model, F.col("a") > 2).alias("p"))
    assert part.filter("(a > 2) <> (p IS NOT NULL)").count() == 0


def test_trees_are_walked_once_per_batch_not_by_lambdas_per_row(data, model):
    """Spark evaluates lambda functions row by row without generated code; 60 trees of depth 6 cost 146 us a row so."""
    x, _, df = data
    scored = df.select(*FEATURES, predict.weights(model).alias("p"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "from_json" not in plan  # no node tables looked up by lambdas
    got = {tuple(r[:4]): r["p"] for r in scored.collect()}
    assert np.allclose([got[tuple(v)] for v in x], model.predict(x), atol=1e-12)


def test_trees_do_not_depend_on_partitions(spark, data, model):
    x, y, _ = data
    for parts in (1, 13):
        again = trees.fit(table(spark, x[::-1], y[::-1], parts), FEATURES, "label", 4, [PARAMS])[0]
        assert again.table() == model.table()


def test_many_nodes_take_several_passes(data, model, monkeypatch):
    monkeypatch.setattr(trees, "PASS_BYTES", 5 * 16 * 4 * 32)
    assert trees.fit(data[2], FEATURES, "label", 4, [PARAMS])[0].table() == model.table()


def test_trials_together_are_trials_alone(data, model):
    other = PARAMS | {"rounds": 2, "max_depth": 5, "lambda": 8.0, "alpha": 0.0}
    together = trees.fit(data[2], FEATURES, "label", 4, [other, PARAMS])
    assert together[1].table() == model.table()
    assert together[0].table() == trees.fit(data[2], FEATURES, "label", 4, [other])[0].table() != model.table()


def test_every_parameter_matters(data, model):
    for change in ({"eta": 0.1}, {"lambda": 20.0}, {"alpha": 3.0}, {"min_child_weight": 40}, {"subsample": 0.5}, {"max_bins": 4}, {"max_depth": 1}):
        assert trees.fit(data[2], FEATURES, "label", 4, [PARAMS | change])[0].table() != model.table(), change


def test_samples_of_rows_repeat(spark, data):
    x, y, df = data
    half = [PARAMS | {"subsample": 0.5}]
    first = trees.fit(df, FEATURES, "label", 4, half)[0].table()
    assert first == trees.fit(table(spark, x, y, 3), FEATURES, "label", 4, half)[0].table()
    assert first != trees.fit(df, FEATURES, "label", 4, half, seed=1)[0].table()
    drawn = trees._drawn(np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 100_000), 0, 0, 42, 0.3)
    assert drawn.mean() == pytest.approx(0.3, abs=0.01)


def test_edges_of_bins(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=5000), rng.integers(0, 7, 5000), np.zeros(5000), np.exp(rng.normal(size=5000) * 20)])
    edges = trees.bin_edges(table(spark, x, np.zeros(5000)), FEATURES, 64)
    assert edges[1].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(edges[2]) == 0
    for f in (0, 3):
        assert 50 <= len(edges[f]) <= 63
        assert np.bincount(np.searchsorted(edges[f], x[:, f], "right")).max() < 3 * 5000 / 64


def test_trees_without_rows_or_choices(spark):
    none = trees.fit(table(spark, np.zeros((0, 4)), []), FEATURES, "label", 4, [PARAMS])[0]
    same = trees.fit(table(spark, np.zeros((9, 4)), [0] * 9), FEATURES, "label", 4, [PARAMS])[0]
    for m in (none, same):
        assert m.predict(np.zeros((2, 4))).tolist() == [[0.25] * 4] * 2
        assert table(spark, np.zeros((1, 4)), [0]).select(predict.weights(m)).first()[0] == [0.25] * 4


def test_unknown_parameters(data):
    with pytest.raises(ValueError, match="depth"):
        train._merged(train.TREE_PARAMS, [{"depth": 3}])


def test_models_survive_storage(data, model, tmp_path):
    x, _, df = data
    small = net.fit(df, FEATURES, "label", 4, [NET])[0]
    for m in (model, small):
        stored.save_model(m, str(tmp_path), m.kind)
        again = stored.load_model(str(tmp_path), m.kind, refresh=True)
        assert (again.predict(x) == m.predict(x)).all() and again.params == m.params and again.features == m.features


# ---- nets -----------------------------------------------------------------------

def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(0)
    sizes, x, y = (4, 6, 5, 3), rng.normal(size=(11, 4)), rng.integers(0, 3, 11)
    w = rng.normal(size=net._count(sizes))
    for dropout in (0.0, 0.4):
        loss = lambda v: net.loss_and_gradient(v, sizes, x, y, dropout, np.random.default_rng(5))[0]
        _, grad = net.loss_and_gradient(w, sizes, x, y, dropout, np.random.default_rng(5))
        for i in range(len(w)):
            up, down = w.copy(), w.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(grad[i], abs=2e-7)


def test_one_part_is_plain_adam(spark):
    """With one part, rounds only cut the row of steps."""
    x, y = numbers(90)
    df = table(spark, x, y, 1)
    got = net.fit(df, FEATURES, "label", 4, [NET | {"dropout": 0.0}], seed=7)[0]
    rows = np.array(df.collect(), float)
    x, y = rows[:, :4].astype(np.float32), rows[:, 4].astype(int)
    w = net.first_weights(got.sizes, 7)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(4):
        order = np.random.default_rng([7, epoch, 0]).permutation(90)
        for i in range(0, 90, 16):
            _, g = net.loss_and_gradient(w, got.sizes, x[order[i:i + 16]], y[order[i:i + 16]])
            g, t = g + 0.01 * w, t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(got.weights, w, atol=1e-3)


def test_loss_falls_and_reruns_agree(spark, data):
    x = data[0]
    y = (x[:, 0] > 2) + 2 * (x[:, 2] > 0)
    df = table(spark, x, y).cache()
    first, again = (net.fit(df, FEATURES, "label", 4, [NET | {"max_epochs": 15, "dropout": 0.1, "hidden": (24, 16)}])[0] for _ in range(2))
    assert (first.weights == again.weights).all() and first.history == again.history
    assert len(first.history) == 15 and first.history[-1] < 0.85 * first.history[0]
    p = first.predict(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.8


def test_nets_together_are_nets_alone(data):
    trials = [NET, NET | {"lr": 0.03, "batch_size": 8}, NET | {"max_epochs": 2, "weight_decay": 0.0}]
    together = net.fit(data[2], FEATURES, "label", 4, trials)
    assert (together[0].weights == net.fit(data[2], FEATURES, "label", 4, trials[:1])[0].weights).all()
    assert len({n.weights.tobytes() for n in together}) == 3 and [len(n.history) for n in together] == [4, 4, 2]
    with pytest.raises(ValueError, match="share"):
        net.fit(data[2], FEATURES, "label", 4, [NET, NET | {"hidden": (3,)}])


def test_net_in_the_engine_and_without_rows(spark, data):
    x, _, df = data
    small = net.fit(df, FEATURES, "label", 4, [NET])[0]
    got = {tuple(r[:4]): r["p"] for r in df.select(*FEATURES, predict.weights(small).alias("p")).collect()}
    assert np.allclose([got[tuple(v)] for v in x], small.predict(x), atol=1e-6)
    assert df.select("a", predict.weights(small, F.col("a") > 2).alias("p")).filter("(a > 2) <> (p IS NOT NULL)").count() == 0
    none = net.fit(table(spark, np.zeros((0, 4)), []), FEATURES, "label", 4, [NET])[0]
    assert (none.weights == net.first_weights(none.sizes, 42)).all() and none.history == []

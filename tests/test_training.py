"""The data-parallel trainer against finite differences and a dense trainer."""

import hashlib
import math

import numpy as np
import pytest

from dockyard.operators import training as N
from dockyard.sources import files

NAN = float("nan")


def toy(n, inputs, outputs, seed=0, kind="binary"):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, inputs))
    side = x @ rng.standard_normal((inputs, outputs))
    if kind == "binary":
        y = (side > 0).astype(float)
        y[rng.random(y.shape) < 0.1] = NAN
    elif kind == "multiclass":
        y = np.eye(outputs)[side.argmax(1)]
    else:
        y = side
        y[rng.random(y.shape) < 0.1] = NAN
    return x, y, rng.uniform(0.5, 2, n)


def frame(spark, x, y, w, parts=3):
    rows = [(i, x[i].tolist(), [None if math.isnan(v) else v for v in y[i].tolist()], float(w[i]), "k") for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, x array<double>, y array<double>, w double, position string").repartition(parts)


@pytest.mark.parametrize("kind", ["binary", "multiclass", "regression"])
@pytest.mark.parametrize("norm", [False, True])
def test_gradients_by_differences(kind, norm):
    net = N.Net(4, (6, 5), 3, kind, dropout=0.3, batch_norm=norm)
    x, y, w = toy(20, 4, 3, kind=kind)
    weights = net.start(1)
    _, grads, moved = N.gradients(net, weights, x, y, w, N.generator(1, 2, 3))
    assert bool(moved) == norm
    for k, g in grads.items():
        for at in [(0,) * g.ndim, tuple(s - 1 for s in g.shape)]:
            ends = []
            for e in (1e-6, -1e-6):
                other = {n: v.copy() for n, v in weights.items()}
                other[k][at] += e
                ends.append(N.gradients(net, other, x, y, w, N.generator(1, 2, 3))[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at])), (k, at)


def dense(x, y, w, sizes, batch, steps, rate, dropout, norm, seed, start):
    """Written out without blocks: one batch after the other in the hash order of an epoch."""
    p = {k: v.copy() for k, v in start.items()}
    m, v2, moving, t = {}, {}, {}, 0
    epoch = 0
    while t < steps:
        order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{i}-{epoch}".encode()).hexdigest(), i))
        for s in range(0, len(x), batch):
            if t == steps:
                break
            rows = order[s : s + batch]
            a, t0, ww, tape = x[rows], y[rows], w[rows], []
            rng = N.generator(seed, t, 0)
            for i in range(len(sizes)):
                z = a @ p[f"pred_layer_{i}/kernel"] + p[f"pred_layer_{i}/bias"]
                r = np.where(z > 0, z, 0)
                keep = (rng.random(r.shape) >= dropout) / (1 - dropout) if dropout else np.ones(r.shape)
                r = r * keep
                mu, var = r.mean(0), ((r - r.mean(0)) ** 2).mean(0)
                hat = (r - mu) / np.sqrt(var + 1e-3)
                out = hat * p[f"BNpred_layer_{i}/gamma"] + p[f"BNpred_layer_{i}/beta"] if norm else r
                tape.append((a, z, keep, mu, var, hat))
                a = out
            q = 1 / (1 + np.exp(-(a @ p["output/kernel"] + p["output/bias"])))
            d = np.where(np.isnan(t0), 0, q - np.nan_to_num(t0)) * ww[:, None] / t0.size
            g = {"output/kernel": a.T @ d, "output/bias": d.sum(0)}
            d = d @ p["output/kernel"].T
            for i in reversed(range(len(sizes))):
                a, z, keep, mu, var, hat = tape[i]
                if norm:
                    g[f"BNpred_layer_{i}/gamma"], g[f"BNpred_layer_{i}/beta"] = (d * hat).sum(0), d.sum(0)
                    e, n = d * p[f"BNpred_layer_{i}/gamma"], len(rows)
                    d = (n * e - e.sum(0) - hat * (e * hat).sum(0)) / n / np.sqrt(var + 1e-3)
                    for name, value in (("mean", mu), ("variance", var)):
                        moving[f"BNpred_layer_{i}/{name}"] = 0.99 * moving.get(f"BNpred_layer_{i}/{name}", start[f"BNpred_layer_{i}/{name}"]) + 0.01 * value
                d = d * keep * (z > 0)
                g[f"pred_layer_{i}/kernel"], g[f"pred_layer_{i}/bias"] = a.T @ d, d.sum(0)
                d = d @ p[f"pred_layer_{i}/kernel"].T
            t += 1
            for k, value in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * value
                v2[k] = 0.999 * v2.get(k, 0) + 0.001 * value**2
                p[k] = p[k] - rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v2[k]) + 1e-7)
        epoch += 1
    return p | moving


@pytest.mark.parametrize("block,dropout,norm", [(16, 0.0, False), (64, 0.25, True)])
def test_five_steps_equal_a_dense_trainer(spark, block, dropout, norm):
    x, y, w = toy(150, 6, 2)
    net = N.Net(6, (8, 4), 2, dropout=dropout, batch_norm=norm)
    got = N.fit(frame(spark, x, y, w), net, "id", w="w", epochs=2, batch=60, block=block, rate=0.01, seed=5)  # batches of 60, 60 and 30, twice
    expected = dense(x, y, w, (8, 4), 60, 6, 0.01, dropout, norm, 5, net.start(5))
    assert set(got.weights) == set(expected)
    for k, v in expected.items():
        assert np.abs(got.weights[k] - v).max() < 1e-6, k
    assert [r["epoch"] for r in got.log] == [0, 1] and got.log[1]["loss"] < got.log[0]["loss"]


def test_learns_stops_and_predicts(spark):
    x, y, w = toy(400, 5, 1, seed=3)
    df = frame(spark, x[:300], y[:300], w)
    val = frame(spark, x[300:], y[300:], w[300:])
    net = N.Net(5, (16,), 1)
    got = N.fit(df, net, "id", val=val, metric="rocauc", epochs=12, batch=75, block=40, rate=0.02, patience=3, schedule=N.step_schedule(0.9))
    assert got.log[got.best_epoch]["val_score"] == max(r["val_score"] for r in got.log) > 90
    assert len(got.log) == 12 or len(got.log) - 1 - got.best_epoch == 3
    assert [r["rate"] for r in got.log[:4]] == pytest.approx([0.02, 0.02, 0.018, 0.018])
    rows = got.predict(val, keep=("id", "position")).orderBy("id").collect()
    p, h, _ = N.forward(net, got.weights, x[300:])
    assert np.allclose([r.score for r in rows], p) and np.allclose([r.embedding for r in rows], h) and rows[0].position == "k"
    log = got.log_rows(spark).collect()
    assert len(log) == len(got.log) and log[0].loss == got.log[0]["loss"]


def test_plateau():
    now = N.plateau_schedule(0.5, patience=2, least=0.01, floor=0.001)
    rows = lambda *v: [{"loss": x} for x in v]
    assert now(0.1, 0, []) == 0.1 and now(0.1, 2, rows(1, 0.5)) == 0.1
    assert now(0.1, 3, rows(1, 1, 1)) == 0.05 and now(0.1, 6, rows(1, 1, 1, 1, 1)) == 0.025


def test_frozen_layers_and_stored_weights(spark, tmp_path):
    x, y, w = toy(200, 5, 3, seed=7)
    first = N.fit(frame(spark, x, y, w), N.Net(5, (8, 6), 3, batch_norm=True), "id", epochs=2, batch=64)
    files.write_weights(first.layers(spark), str(tmp_path / "w"))
    # Another number of tasks: the output's weights don't fit, all others are taken over and frozen, one layer for good.
    net = N.tower(first.net, outputs=1)
    stored = N.from_layers(spark.read.parquet(str(tmp_path / "w")))
    freeze = {"pred_layer_0": None, "pred_layer_1": 2}
    data = frame(spark, x, y[:, :1], w)
    runs = {e: N.fit(data, net, "id", epochs=e, batch=64, start=stored, freeze=freeze) for e in (2, 3)}
    moves = lambda e, layer: any((runs[e].weights[k] != stored[k]).any() for k in stored if N.layer_of(k) == layer)
    for layer in ("pred_layer_0", "BNpred_layer_0"):
        assert not moves(2, layer) and not moves(3, layer)  # bit-equal
    for layer in ("pred_layer_1", "BNpred_layer_1"):
        assert not moves(2, layer) and moves(3, layer)
    assert (runs[2].weights["output/kernel"] != net.start(92)["output/kernel"]).any()
    assert [r["frozen"] for r in runs[3].log] == [4, 4, 2]


def test_odd_tables(spark):
    net = N.Net(2, (3,), 1)
    rows = [(1, [1.0, 2.0], [1.0]), (2, None, [0.0]), (3, [0.0, 1.0], None), (4, [1.0, 1.0], [None]), (4, [1.0, 1.0], [0.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    got = N.fit(df, net, "id", epochs=1, batch=2, block=1)
    assert np.isfinite(got.weights["output/kernel"]).all()
    empty = N.fit(df.limit(0), net, "id", epochs=1)
    assert all((empty.weights[k] == v).all() for k, v in net.start(92).items())
    assert empty.predict(df.limit(0)).count() == 0

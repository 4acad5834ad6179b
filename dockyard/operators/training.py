"""A data-parallel trainer of feed-forward nets: Dense, ReLU, dropout, batch norm, Adam, masked and weighted losses.

Rows are dealt to batches in a hash order and packed into blocks of ``block`` rows, written once as a table partitioned by
batch. A step reads one batch: tasks sum the gradients of their blocks with the weights that the step broadcast, a few tasks add
these sums up, and the driver, which holds nothing but the weights and Adam's moments, moves the weights. So a step
moves twice the size of the weights for each task, whatever the rows, and rows never reach the driver.

Dropout masks come from a counter-based generator keyed by seed, step and block, so a task that runs again gives the same
sums. Batch norm takes the mean and variance of a block, as data-parallel trainers do; moving averages are means over
blocks by rows. A layer may be frozen for good or until an epoch: its weights and moving averages do not change, and its
batch norm uses the stored averages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.functions.metrics import areas_of, mse
from dockyard.operators.lineage import written
from dockyard.operators.splits import batches

Weights = dict[str, np.ndarray]
EPS, MOMENTUM = 1e-3, 0.99
#: Tasks that add up the sums of all others before the driver does.
FAN = 4


@dataclass(frozen=True)
class Net:
    """Sizes of the hidden layers; ``kind`` is ``binary`` (a sigmoid for each task), ``multiclass`` (softmax) or ``regression``."""

    inputs: int
    hidden: tuple[int, ...]
    outputs: int
    kind: str = "binary"
    dropout: float = 0.0
    batch_norm: bool = False
    prefix: str = ""

    def layers(self) -> list[str]:
        """Names in order: ``pred_layer_i``, ``BNpred_layer_i`` and ``output``, with the prefix."""
        own = [[f"pred_layer_{i}"] + [f"BNpred_layer_{i}"] * self.batch_norm for i in range(len(self.hidden))]
        return [self.prefix + n for n in [*sum(own, []), "output"]]

    def start(self, seed: int = 92) -> Weights:
        """Glorot-uniform kernels, zero biases, batch norm that changes nothing."""
        rng, out, last = np.random.default_rng(seed), {}, self.inputs
        for i, size in enumerate([*self.hidden, self.outputs]):
            name = self.prefix + (f"pred_layer_{i}" if i < len(self.hidden) else "output")
            limit = np.sqrt(6 / (last + size))
            out[f"{name}/kernel"] = rng.uniform(-limit, limit, (last, size))
            out[f"{name}/bias"] = np.zeros(size)
            if self.batch_norm and i < len(self.hidden):
                norm = f"{self.prefix}BNpred_layer_{i}"
                out |= {f"{norm}/gamma": np.ones(size), f"{norm}/beta": np.zeros(size), f"{norm}/mean": np.zeros(size), f"{norm}/variance": np.ones(size)}
            last = size
        return out


def layer_of(weight: str) -> str:
    return weight.rpartition("/")[0]


def activate(net: Net, z: np.ndarray) -> np.ndarray:
    if net.kind == "binary":
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
    if net.kind == "multiclass":
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return z


def forward(net: Net, weights: Weights, x: np.ndarray, rng: np.random.Generator | None = None, frozen: frozenset[str] = frozenset()):
    """Outputs, last hidden state and what the way back needs; with ``rng`` as in training (dropout, statistics of the rows)."""
    kept, h = [], x
    for i in range(len(net.hidden)):
        name, norm = f"{net.prefix}pred_layer_{i}", f"{net.prefix}BNpred_layer_{i}"
        z = h @ weights[f"{name}/kernel"] + weights[f"{name}/bias"]
        a = np.maximum(z, 0)
        mask = None
        if rng is not None and net.dropout:
            mask = (rng.random(a.shape) >= net.dropout) / (1 - net.dropout)
            a = a * mask
        stats = None
        if net.batch_norm:
            own = rng is not None and norm not in frozen
            mean, var = (a.mean(0), a.var(0)) if own else (weights[f"{norm}/mean"], weights[f"{norm}/variance"])
            scale = 1 / np.sqrt(var + EPS)
            centred = (a - mean) * scale
            stats = (own, mean, var, scale, centred)
            a = centred * weights[f"{norm}/gamma"] + weights[f"{norm}/beta"]
        kept.append((h, z, mask, stats))
        h = a
    out = h @ weights[f"{net.prefix}output/kernel"] + weights[f"{net.prefix}output/bias"]
    return activate(net, out), h, kept


def losses(net: Net, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss of each cell (of each row for ``multiclass``); missing targets (NaN) cost nothing."""
    known = ~np.isnan(y)
    t, q = np.where(known, y, 0), np.clip(p, 1e-7, 1 - 1e-7)
    if net.kind == "binary":
        return np.where(known, -(t * np.log(q) + (1 - t) * np.log(1 - q)), 0)
    if net.kind == "multiclass":
        return -(t * np.log(q)).sum(1, keepdims=True)
    return np.where(known, (p - t) ** 2, 0)


def gradients(net: Net, weights: Weights, x, y, w, rng, frozen: frozenset[str] = frozenset()) -> tuple[float, Weights, Weights]:
    """Sums over rows: the weighted loss, its gradients, and (by rows) the batch norms' means and variances."""
    p, last, kept = forward(net, weights, x, rng, frozen)
    loss = float((losses(net, p, y) * w[:, None]).sum())
    grads: Weights = {}
    known = ~np.isnan(y)
    d = np.where(known, p - np.where(known, y, 0), 0) * w[:, None]
    if net.kind == "multiclass":
        t = np.where(known, y, 0)
        d = (p * t.sum(1, keepdims=True) - t) * w[:, None]
    elif net.kind == "regression":
        d = 2 * d
    out = f"{net.prefix}output"
    grads[f"{out}/kernel"], grads[f"{out}/bias"] = last.T @ d, d.sum(0)
    back, moved = d @ weights[f"{out}/kernel"].T, {}
    for i in reversed(range(len(net.hidden))):
        name, norm = f"{net.prefix}pred_layer_{i}", f"{net.prefix}BNpred_layer_{i}"
        h, z, mask, stats = kept[i]
        if stats is not None:
            own, mean, var, scale, centred = stats
            grads[f"{norm}/gamma"], grads[f"{norm}/beta"] = (back * centred).sum(0), back.sum(0)
            g = back * weights[f"{norm}/gamma"]
            if own:
                back = scale * (g - g.mean(0) - centred * (g * centred).mean(0))
                moved |= {f"{norm}/mean": mean * len(x), f"{norm}/variance": var * len(x)}
            else:
                back = g * scale
        if mask is not None:
            back = back * mask
        back = back * (z > 0)
        grads[f"{name}/kernel"], grads[f"{name}/bias"] = h.T @ back, back.sum(0)
        back = back @ weights[f"{name}/kernel"].T
    return loss, {k: g for k, g in grads.items() if layer_of(k) not in frozen}, moved


def generator(seed: int, step: int, block: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, (step << 24) + block]))


@dataclass
class Adam:
    """Moments and steps by weight: a layer that is released later starts with its own first step."""

    rate: float = 0.001
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-7
    state: dict[str, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def step(self, weights: Weights, grads: Weights) -> None:
        for k, g in grads.items():
            t, m, v = self.state.get(k, (0, np.zeros_like(g), np.zeros_like(g)))
            t, m, v = t + 1, self.b1 * m + (1 - self.b1) * g, self.b2 * v + (1 - self.b2) * g * g
            self.state[k] = t, m, v
            rate = self.rate * np.sqrt(1 - self.b2**t) / (1 - self.b1**t)
            weights[k] = weights[k] - rate * m / (np.sqrt(v) + self.eps)


# --- what a step hands on ------------------------------------------------------------------------------------------------

SUMS = "slot int, rows long, loss double, sums binary"


def _flat(parts: Weights, names: list[tuple[str, tuple[int, ...]]]) -> np.ndarray:
    return np.concatenate([np.ravel(parts[k]) if k in parts else np.zeros(int(np.prod(s))) for k, s in names])


def _named(flat: np.ndarray, names: list[tuple[str, tuple[int, ...]]]) -> Weights:
    out, at = {}, 0
    for k, s in names:
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def packed(df: DataFrame, key: str, x: str, y: str, w: str | None, batch: int, block: int, epoch: int) -> str:
    """Write the rows of an epoch as blocks (``batch``, ``block``, ``n``, ``x``, ``y``, ``w``) and return the folder."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(F.col(key).alias("_key"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), weight.alias("w"))
    dealt = batches(rows, "_key", batch, epoch).withColumn("block", F.floor(F.col("position") % batch / block).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        nums = [np.array(group[c].tolist(), dtype="<f8").reshape(len(group), -1).tobytes() for c in ("x", "y", "w")]
        head = [int(group["batch"].iloc[0]), int(group["block"].iloc[0]), len(group)]
        return pd.DataFrame([(*head, *nums)], columns=["batch", "block", "n", "x", "y", "w"])

    own = dealt.select("batch", "block", "position", "x", F.transform("y", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("y"), "w")
    made = own.groupBy("batch", "block").applyInPandas(pack, "batch long, block int, n long, x binary, y binary, w binary")
    return written(made, "batch")


def _arrays(row, net: Net):
    x, y, w = (np.frombuffer(row[c], "<f8").reshape(row["n"], -1) for c in ("x", "y", "w"))
    return x, y, w[:, 0]


def batch_gradients(blocks: DataFrame, net: Net, weights: Weights, seed: int, step: int, frozen: frozenset[str]) -> tuple[int, float, Weights, Weights]:
    """Rows, summed loss, summed gradients and summed statistics of one batch's blocks."""
    shapes = [(k, v.shape) for k, v in weights.items()]
    slots = [(f"g:{k}", s) for k, s in shapes] + [(f"s:{k}", s) for k, s in shapes if k.endswith(("/mean", "/variance"))]
    sent = blocks.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows, loss, slot = None, 0, 0.0, 0
        for b in parts:
            for _, row in b.iterrows():
                x, y, w = _arrays(row, net)
                cost, grads, moved = gradients(net, sent.value, x, y, w, generator(seed, step, int(row["block"])), frozen)
                flat = _flat({f"g:{k}": v for k, v in grads.items()} | {f"s:{k}": v for k, v in moved.items()}, slots)
                total = flat if total is None else total + flat
                rows, loss, slot = rows + len(x), loss + cost, int(row["block"])
        if total is not None:
            yield pd.DataFrame([(slot % FAN, rows, loss, total.tobytes())], columns=["slot", "rows", "loss", "sums"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, "<f8") for s in group["sums"])
        return pd.DataFrame([(int(group["slot"].iloc[0]), int(group["rows"].sum()), float(group["loss"].sum()), total.tobytes())], columns=["slot", "rows", "loss", "sums"])

    found = blocks.mapInPandas(summed, SUMS).groupBy("slot").applyInPandas(added, SUMS).collect()  # at most FAN rows
    found.sort(key=lambda r: r.slot)
    flat = sum(np.frombuffer(r.sums, "<f8") for r in found)
    named = _named(flat, slots)
    sent.unpersist()
    grads = {k: named[f"g:{k}"] for k, _ in shapes if layer_of(k) not in frozen and not k.endswith(("/mean", "/variance"))}
    moved = {k[2:]: v for k, v in named.items() if k.startswith("s:") and layer_of(k[2:]) not in frozen}
    return sum(r.rows for r in found), sum(r.loss for r in found), grads, moved


def apply_step(net: Net, weights: Weights, adam: Adam, rows: int, grads: Weights, moved: Weights) -> None:
    """Move the weights by the batch's mean gradient: over all cells, missing ones included, or rows for ``multiclass``."""
    cells = rows * (1 if net.kind == "multiclass" else net.outputs)
    adam.step(weights, {k: g / cells for k, g in grads.items()})
    for k, v in moved.items():
        weights[k] = MOMENTUM * weights[k] + (1 - MOMENTUM) * v / rows


# --- schedules, transfer, the loop --------------------------------------------------------------------------------------


def step_schedule(rate: float, every: int = 2) -> Callable[[float, int, list[dict]], float]:
    """The rate times ``rate`` for each ``every`` epochs that have passed."""
    return lambda first, epoch, log: first * rate ** (epoch // every)


def plateau_schedule(factor: float = 0.2, patience: int = 2, least: float = 1e-4, floor: float = 0.001) -> Callable[[float, int, list[dict]], float]:
    """The rate times ``factor`` whenever the validation loss has not fallen by ``least`` for ``patience`` epochs."""

    def now(first: float, epoch: int, log: list[dict]) -> float:
        rate, best, wait = first, np.inf, 0
        for row in log:
            value = row.get("val_loss", row["loss"])
            best, wait = (value, 0) if value < best - least else (best, wait + 1)
            if wait >= patience:
                rate, wait = max(rate * factor, min(floor, first)), 0
        return rate

    return now


def frozen_at(net: Net, freeze: dict[str, int | None], epoch: int) -> frozenset[str]:
    """Layers that don't move in ``epoch``: ``freeze`` gives, by pattern of names, the epoch that releases them (None: never)."""
    return frozenset(n for n in net.layers() for p, e in freeze.items() if re.search(p, n) and (e is None or epoch < e))


@dataclass
class Fitted:
    net: Net
    weights: Weights
    log: list[dict]
    best_epoch: int

    def predict(self, df: DataFrame, x: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
        """``keep``, then ``score`` (one a task) and ``embedding`` (the last hidden state), by batches of rows in tasks."""
        net, sent = self.net, df.sparkSession.sparkContext.broadcast(self.weights)
        rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(0).alias("_kept"), F.col(x).cast("array<double>").alias("_x"))

        @F.pandas_udf("score array<double>, embedding array<double>")
        def scored(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"score": [], "embedding": []})
            p, h, _ = forward(net, sent.value, np.array(v.tolist(), dtype=float).reshape(len(v), net.inputs))
            return pd.DataFrame({"score": list(p), "embedding": list(h)})

        out = rows.select("_kept", scored("_x").alias("_p"))
        return out.select(*[F.col("_kept")[c].alias(c) for c in keep], "_p.score", "_p.embedding")

    def layers(self, spark) -> DataFrame:
        """The weights as a table (``layer``, ``shape``, ``values``), for ``write_weights``."""
        rows = [(k, list(map(int, v.shape)), v.ravel().tolist()) for k, v in self.weights.items()]
        return spark.createDataFrame(rows, "layer string, shape array<int>, values array<double>")

    def log_rows(self, spark) -> DataFrame:
        return spark.createDataFrame([(r["epoch"], float(r["rate"]), float(r["loss"]), r.get("val_loss"), r.get("val_score"), r["frozen"]) for r in self.log], "epoch int, rate double, loss double, val_loss double, val_score double, frozen int")


def from_layers(layers: DataFrame) -> Weights:
    """Weights of a table of layers, of a model's fixed size."""
    return {r["layer"]: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in layers.collect()}


def evaluate(fitted: Fitted, df: DataFrame, x: str, y: str, metric: str) -> tuple[float, float]:
    """Validation loss (mean over cells) and score (mean over tasks of ``metric``: aupr, rocauc, or mse)."""
    net = fitted.net
    scored = fitted.predict(df.withColumn("_y", F.col(y).cast("array<double>")), x, ("_y",))
    cells = scored.select(F.posexplode(F.arrays_zip(F.col("_y").alias("y"), "score")).alias("task", "c")).select("task", "c.y", "c.score")
    cells = cells.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    q = F.greatest(F.least("score", F.lit(1 - 1e-7)), F.lit(1e-7))
    if net.kind == "regression":
        loss = F.pow(F.col("score") - F.col("y"), 2)
    elif net.kind == "binary":
        loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    else:
        loss = -F.col("y") * F.log(q) * net.outputs
    cost = cells.agg(F.avg(F.coalesce(loss, F.lit(0.0)))).first()[0]
    found = mse(cells, ["task"]) if metric == "mse" else areas_of(cells, ["task"], [metric])
    return float(cost or 0.0), float(found.agg(F.avg(metric)).first()[0] or 0.0)


def fit(
    train: DataFrame,
    net: Net,
    key: str,
    x: str = "x",
    y: str = "y",
    w: str | None = None,
    val: DataFrame | None = None,
    metric: str = "aupr",
    epochs: int = 10,
    batch: int = 4096,
    block: int = 1024,
    rate: float = 0.001,
    schedule: Callable[[float, int, list[dict]], float] | None = None,
    patience: int | None = None,
    start: Weights | None = None,
    freeze: dict[str, int | None] | None = None,
    reshuffle: bool = True,
    seed: int = 92,
) -> Fitted:
    """Train; keep the best epoch's weights by ``metric`` on ``val`` (lower is better for ``mse``), or the last ones.

    ``train`` has a ``key`` (any type; it orders the rows), features ``x`` (arrays of ``net.inputs`` numbers), targets ``y`` (arrays of
    ``net.outputs``, null or NaN where missing, one-hot for ``multiclass``) and perhaps a weight ``w``. ``patience`` epochs without a
    better score end the fit. ``start`` gives weights to begin with (of other models by name, others keep their start);
    ``freeze``: see ``frozen_at``. Rows without features or targets are left out; an empty table gives the start.
    """
    weights = net.start(seed)
    for k, v in (start or {}).items():
        if k in weights and weights[k].shape == v.shape:
            weights[k] = v.copy()
    rows = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    adam, log, folder, step = Adam(rate), [], None, 0
    best: tuple[float, int, Weights] | None = None
    sign = -1 if metric == "mse" else 1
    for epoch in range(epochs):
        if folder is None or reshuffle:
            folder = packed(rows, key, x, y, w, batch, block, epoch)
            stored = rows.sparkSession.read.schema("block int, n long, x binary, y binary, w binary, batch long").parquet(folder)
            numbers = sorted(r.batch for r in stored.select("batch").distinct().collect())
        frozen = frozen_at(net, freeze or {}, epoch)
        adam.rate = schedule(rate, epoch, log) if schedule else rate
        cost = seen = 0.0
        for s in numbers:
            n, loss, grads, moved = batch_gradients(stored.where(F.col("batch") == s), net, weights, seed, step, frozen)
            apply_step(net, weights, adam, n, grads, moved)
            cost, seen, step = cost + loss, seen + n * (1 if net.kind == "multiclass" else net.outputs), step + 1
        row = {"epoch": epoch, "rate": adam.rate, "loss": cost / max(seen, 1.0), "frozen": len(frozen)}
        if val is not None:
            row["val_loss"], row["val_score"] = evaluate(Fitted(net, weights, log, epoch), val, x, y, metric)
            if best is None or sign * row["val_score"] > sign * best[0]:
                best = row["val_score"], epoch, dict(weights)
        log.append(row)
        if best is not None and patience is not None and epoch - best[1] >= patience:
            break
    return Fitted(net, best[2] if best else weights, log, best[1] if best else max(0, len(log) - 1))


def tower(net: Net, **changes) -> Net:
    """The same net with some sizes or names changed, such as another number of tasks for a transfer."""
    return replace(net, **changes)

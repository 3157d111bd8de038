"""A softmax-regression model kept as a table of parameters (c, j, w): scoring, gradients and one optimiser step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import argmax, dot, literal, softmax

PARAMS = "c int, j int, w double"


def centroid_params(rows: DataFrame, scale: float = 8.0) -> DataFrame:
    """Parameters without training: each class's mean features, scaled."""
    long = rows.select("label", F.posexplode("features").alias("j", "v"))
    return long.groupBy(F.col("label").alias("c"), "j").agg((F.avg("v") * scale).alias("w"))


def to_matrix(params: DataFrame, classes: int, width: int) -> np.ndarray:
    """Parameters at the driver: classes * width numbers, set by the model and not by the data."""
    out = np.zeros((classes, width))
    for r in params.collect():
        out[r["c"], r["j"]] = r["w"]
    return out


def from_matrix(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(c, j, float(w[c, j])) for c in range(w.shape[0]) for j in range(w.shape[1])], PARAMS)


def score(rows: DataFrame, params: DataFrame | np.ndarray) -> DataFrame:
    """Adds logits, probs, pred and confidence to every row, without a shuffle of the rows.

    A table of parameters joins as one broadcast row of arrays; its size is the model's.
    """
    if isinstance(params, np.ndarray):
        w = F.array(*(literal(row) for row in params.tolist()))
        with_w = rows.withColumn("_w", w)
    else:
        by_class = params.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]).alias("ws"))
        one = by_class.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "ws"))), lambda x: x["ws"]).alias("_w"))
        with_w = rows.crossJoin(F.broadcast(one))
    out = with_w.withColumn("logits", F.transform("_w", lambda w: dot(w, F.col("features")))).drop("_w")
    out = out.withColumn("probs", softmax(F.col("logits"))).withColumn("pred", argmax(F.col("logits")))
    return out.withColumn("confidence", F.array_max("probs"))


def matrix(features: pa.Array) -> np.ndarray:
    """A column of equally long arrays."""
    return features.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(features), -1)


def gradients(rows: DataFrame, w: np.ndarray, keys: list[str] = [], weights: list[float] | None = None) -> DataFrame:  # noqa: B006
    """Sums over rows, by keys, of the cross-entropy's gradient (c, j, g), its loss and the rows' weights.

    Each batch is one matrix product in the task; only classes * width sums a batch and key are shuffled.
    """
    class_weights = np.ones(len(w)) if weights is None else np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("features"))
            y = batch.column("label").to_numpy()
            z = x @ w.T
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            weight = class_weights[y]
            loss = -np.log(p[np.arange(len(y)), y]) * weight
            p[np.arange(len(y)), y] -= 1
            p *= weight[:, None]
            groups = np.stack([batch.column(k).to_numpy() for k in keys], 1) if keys else np.zeros((len(y), 1), np.int64)
            for key in np.unique(groups, axis=0):
                on = (groups == key).all(1)
                g = p[on].T @ x[on]
                size = g.size
                arrays = [pa.array(np.full(size, k), pa.int64()) for k in (key if keys else [])]
                arrays += [pa.array(np.repeat(np.arange(len(w)), w.shape[1]), pa.int32()), pa.array(np.tile(np.arange(w.shape[1]), len(w)), pa.int32()), pa.array(g.ravel())]
                arrays += [pa.array(np.full(size, v)) for v in (loss[on].sum(), weight[on].sum(), float(on.sum()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "c", "j", "g", "loss", "weight", "n"])

    schema = "".join(f"{k} long, " for k in keys) + "c int, j int, g double, loss double, weight double, n double"
    parts = rows.select("features", "label", *(F.col(k).cast("long").alias(k) for k in keys)).mapInArrow(run, schema)
    return parts.groupBy(*keys, "c", "j").agg(*(F.sum(x).alias(x) for x in ("g", "loss", "weight", "n")))


def class_weights(rows: DataFrame, classes: int) -> DataFrame:
    """N / (C n_c) for the classes that are present."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_c"))
    return counts.crossJoin(F.broadcast(totals)).select("label", "n", (F.col("_all") / (F.col("_c") * F.col("n"))).alias("weight"))


def adam_step(params: DataFrame, grads: DataFrame, step: int = 1, rate: float = 1e-4, decay: float = 1e-4, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """One step from zero moments, or from params' columns m and v; the decay is part of the gradient."""
    m0, v0 = ((F.col(k) if k in params.columns else F.lit(0.0)) for k in ("m", "v"))
    g = F.col("g") + decay * F.col("w")
    m, v = b1 * m0 + (1 - b1) * g, b2 * v0 + (1 - b2) * g * g
    new = F.col("w") - rate * (m / (1 - b1**step)) / (F.sqrt(v / (1 - b2**step)) + eps)
    return params.join(grads.select("c", "j", "g"), ["c", "j"]).select("c", "j", new.alias("w"), m.alias("m"), v.alias("v"))


class Adam:
    """Adam with the decay in the gradient, over a small matrix at the driver or in a task."""

    def __init__(self, rate: float = 1e-4, decay: float = 1e-4):
        self.rate, self.decay, self.step = rate, decay, 0
        self.m = self.v = 0.0

    def __call__(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def train_two_phase(rows: DataFrame, classes: int, width: int, epochs: int, freeze_epochs: int, frozen: list[int], rate: float = 1e-2, rate_drop: float = 0.1) -> tuple[np.ndarray, list[dict]]:
    """Full-batch training, first with the parameters of the given features frozen, then all at a tenth of the rate with a fresh optimiser.

    Returns the parameters and a history of loss for each epoch. Each epoch is one job; rows should be persisted.
    """
    w, history = np.zeros((classes, width)), []
    for epoch in range(epochs):
        if epoch in (0, freeze_epochs):
            adam = Adam(rate if epoch < freeze_epochs else rate * rate_drop)
        got = gradients(rows, w).collect()
        g = np.zeros_like(w)
        for r in got:
            g[r["c"], r["j"]] = r["g"] / r["weight"]
        if epoch < freeze_epochs:
            g[:, frozen] = 0
            kept = w[:, frozen].copy()
        w = adam(w, g)
        if epoch < freeze_epochs:
            w[:, frozen] = kept
        history.append({"epoch": epoch, "loss": got[0]["loss"] / got[0]["weight"], "phase": "frozen" if epoch < freeze_epochs else "all"})
    return w, history


def grad_norm(grads: DataFrame) -> DataFrame:
    return grads.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))


def clip_by_norm(grads: DataFrame, most: float, guard: float = 1e-6) -> DataFrame:
    """Gradients scaled so that the norm over all of them is at most `most`."""
    return grads.crossJoin(F.broadcast(grad_norm(grads))).withColumn("clipped", F.col("g") * F.least(F.lit(1.0), most / (F.col("norm") + guard)))


def count_params(params: DataFrame, frozen: Column) -> DataFrame:
    return params.agg(F.count(F.lit(1)).alias("total"), F.count_if(~frozen).alias("trainable"))


def freeze_schedule(epochs: DataFrame, freeze_epochs: int, rate: float = 1e-4) -> DataFrame:
    """Epochs with their phase and rate: frozen up to freeze_epochs, then all at a tenth by a fresh optimiser."""
    on = F.col("epoch") < freeze_epochs
    return epochs.select("epoch", F.when(on, "frozen").otherwise("all").alias("phase"), F.when(on, rate).otherwise(rate * 0.1).alias("rate"), (F.col("epoch") == freeze_epochs).alias("fresh_optimiser"))

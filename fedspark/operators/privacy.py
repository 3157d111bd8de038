"""Differential privacy by clipped and noisy gradients, its accounting, and membership inference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_gauss
from ..functions.ranking import running, sketched
from .model import clip_by_norm, gradients, matrix

#: Noise multipliers by target epsilon (fixed values); others take the default.
SIGMAS = ((1.0, 2.0), (1.5, 1.5), (2.0, 1.1), (5.0, 0.7), (10.0, 0.5))
DEFAULT_SIGMA = 1.0
#: Thresholds 0.10 to 0.99, as numpy steps them.
THRESHOLDS = [float(t) for t in np.arange(0.1, 1.0, 0.01)]


def epsilon_simple(sigma: Column, steps: Column, rate: Column, delta: float = 1e-5) -> Column:
    """q sqrt(2 T ln(1 / delta)) / sigma, and infinity without noise. A rule of thumb and no bound of a moments accountant."""
    return F.when(sigma == 0, F.lit(float("inf"))).otherwise(F.try_divide(rate * F.sqrt(2.0 * steps * math.log(1 / delta)), sigma))


def sample_rate(n: Column, batch: int = 32) -> Column:
    return F.least(F.lit(float(batch)) / n, F.lit(1.0))


def sigma_for(target: Column) -> Column:
    out = F.lit(DEFAULT_SIGMA)
    for t, s in SIGMAS:
        out = F.when(target == t, s).otherwise(out)
    return out


def noisy_gradient(grads: DataFrame, sigma: float, most: float, batch: int, seed: int = 42) -> DataFrame:
    """Gradients clipped by their common norm, with noise sigma * most / batch. The hash noise is for tests; it gives no privacy."""
    key = F.concat(F.col("c").cast("string"), F.lit("_"), F.col("j").cast("string"))
    return clip_by_norm(grads, most).withColumn("noisy", F.col("clipped") + hash_gauss(seed, key) * (sigma * most / batch))


def per_row_clipped(rows: DataFrame, w: np.ndarray, most: float) -> DataFrame:
    """Sum of rows' gradients (c, j, g), each first scaled to a norm of `most` at most: what a private sum needs.

    A row's gradient is (p - y) x', so its norm is the product of two norms; the scale is a weight of the row. Each
    batch is one matrix product, and a task sends classes * width sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(w)
        for batch in batches:
            if not len(batch):
                continue
            x, y = matrix(batch.column("features")), batch.column("label").to_numpy()
            z = x @ w.T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            norm = np.sqrt((p * p).sum(1)) * np.sqrt((x * x).sum(1))
            p *= np.minimum(1.0, most / np.maximum(norm, 1e-300))[:, None]
            total += p.T @ x
        c, j = np.indices(w.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["c", "j", "g"])

    return rows.select("features", "label").mapInArrow(run, "c int, j int, g double").groupBy("c", "j").agg(F.sum("g").alias("g"))


def private_train(rows: DataFrame, classes: int, width: int, steps: int, sigma: float, most: float, rate: float = 0.5, target: float | None = None, delta: float = 1e-5, seed: int | None = None) -> tuple[np.ndarray, list[dict]]:
    """Full-batch descent on per-row clipped sums with fresh Gaussian noise from the system's generator; a seed is for tests, and gives no privacy.

    Stops after the first step whose simple epsilon passes twice the target. Returns the parameters and the ledger.
    """
    rng, w, ledger, n = np.random.default_rng(seed), np.zeros((classes, width)), [], rows.count()
    for t in range(1, steps + 1):
        g = np.zeros_like(w)
        for r in per_row_clipped(rows, w, most).collect():
            g[r["c"], r["j"]] = r["g"]
        w = w - rate * (g + rng.standard_normal(g.shape) * sigma * most) / max(n, 1)
        spent = math.sqrt(2 * t * math.log(1 / delta)) / sigma if sigma else math.inf
        ledger.append({"step": t, "epsilon_simple": spent})
        if target is not None and spent > 2 * target:
            break
    return w, ledger


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in THRESHOLDS], "t double")


def attack_sweep(members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, accuracy): the share of rows (confidence, member) whose `confidence >= t` says whether they are members.

    Rows are counted by the threshold they still reach, which is one small aggregation; the sums over thresholds follow.
    """
    spark = members.sparkSession
    reached = F.size(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: F.col("confidence") >= t))
    counts = members.groupBy(*keys, reached.alias("reached")).agg(F.sum("member").alias("m"), F.sum(1 - F.col("member")).alias("o"))
    index = spark.createDataFrame(list(enumerate(THRESHOLDS)), "i int, t double")
    pairs = index.crossJoin(F.broadcast(counts))  # 90 thresholds and at most 91 counts a key
    hits = F.when(F.col("reached") > F.col("i"), F.col("m")).otherwise(F.col("o"))
    return pairs.groupBy(*keys, "t").agg((F.sum(hits) / F.sum(F.col("m") + F.col("o"))).alias("accuracy"))


def best_attack(sweep: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The lowest of the best thresholds, of each key: accuracy and advantage in percent, beside the rate of always saying member."""
    best = sweep.groupBy(*keys).agg(F.max(F.struct("accuracy", (-F.col("t")).alias("t"))).alias("_best")).filter("_best is not null")
    return best.select(*keys, F.col("_best.accuracy").alias("accuracy"), (-F.col("_best.t")).alias("t")).select(*keys, (F.col("accuracy") * 100).alias("accuracy_pct"), (F.col("accuracy") * 100 - 50).alias("advantage_pct"), F.col("t").alias("threshold"))


def attack_curve(members: DataFrame) -> DataFrame:
    """(confidence, tpr, fpr) for each distinct confidence to six decimals: shares of members and others at or above it."""
    points = members.groupBy(F.round("confidence", 6).alias("confidence")).agg(F.sum("member").alias("m"), F.sum(1 - F.col("member")).alias("o"))
    down = running(points, -sketched(points, "confidence"), [F.desc("confidence")], {"mt": "m", "ot": "o"})
    totals = points.agg(F.sum("m").alias("_m"), F.sum("o").alias("_o"))
    return down.crossJoin(F.broadcast(totals)).select("confidence", (F.col("mt") / F.col("_m")).alias("tpr"), (F.col("ot") / F.col("_o")).alias("fpr"))


def balanced_attack(members: DataFrame) -> DataFrame:
    """Balanced accuracy at the best threshold for it, and the majority's rate, against which a plain accuracy must be read."""
    curve = attack_curve(members)
    best = curve.select("confidence", ((F.col("tpr") + 1 - F.col("fpr")) / 2).alias("balanced_accuracy")).orderBy(F.desc(F.round("balanced_accuracy", 9)), F.desc("confidence")).limit(1)
    share = members.agg(F.avg("member").alias("_share"))
    return best.crossJoin(share).select("balanced_accuracy", F.col("confidence").alias("threshold"), F.greatest("_share", 1 - F.col("_share")).alias("majority_rate"))


def mean_gradient(rows: DataFrame, w: np.ndarray) -> DataFrame:
    return gradients(rows, w).select("c", "j", (F.col("g") / F.col("n")).alias("g"))

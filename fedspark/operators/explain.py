"""Attributions: class-activation maps by gradients, and Shapley values of a linear model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_of
from ..functions.vectors import let, mean
from .model import matrix

#: Numbers that the path points of one step hold, about.
STEP_CELLS = 1 << 21


def activation_map(act: Column, grad: Column, channels: int, cells: int) -> Column:
    """The map of activations and gradients (arrays, channel after channel of `cells`): channels weighted by their mean
    gradient, then ReLU. All within the row."""
    weight = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: mean(F.slice(grad, k * cells + 1, cells)))
    at = F.sequence(F.lit(0), F.lit(channels - 1))
    heat = lambda w: F.transform(F.sequence(F.lit(1), F.lit(cells)), lambda p: F.greatest(F.lit(0.0), F.aggregate(at, F.lit(0.0), lambda s, k: s + F.get(w, k) * F.element_at(act, (k * cells + p).cast("int")))))
    return let(weight, heat)


def scale_map(heat: Column) -> Column:
    """A map to [0, 1] where its largest value is above 0; a constant positive one has no range, and its values become null."""
    return let(F.array_min(heat), lambda low: let(F.array_max(heat), lambda high: F.transform(heat, lambda v: F.when(high > 0, F.try_divide(v - low, high - low)).otherwise(v))))


def shap_linear(rows: DataFrame, params: DataFrame, background: DataFrame) -> DataFrame:
    """(id, c, phi) with phi = w (x - the background's mean) for each feature: exact for a linear model.

    Parameters and means are one row of arrays, of the model's size, that every row meets; nothing is shuffled but they.
    """
    by_j = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("j", value))), lambda x: x[value])
    means = background.select(F.posexplode("features").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).agg(by_j("m").alias("_mean"))
    models = params.groupBy("c").agg(by_j("w").alias("w")).agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("_models"))
    met = rows.select("id", "features").crossJoin(F.broadcast(means.crossJoin(models)))
    each = met.select("id", F.zip_with("features", "_mean", lambda x, m: x - m).alias("_way"), F.explode("_models").alias("_model"))
    return each.select("id", F.col("_model.c").alias("c"), F.zip_with("_way", F.col("_model.w"), lambda d, w: w * d).alias("phi"))


def background_logits(params: DataFrame, background: DataFrame) -> DataFrame:
    """(c, base): the logits of the background's mean."""
    mean = background.select(F.posexplode("features").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("_mean"))
    return params.join(F.broadcast(mean), "j").groupBy("c").agg(F.sum(F.col("w") * F.col("_mean")).alias("base"))


def importance(phi: DataFrame) -> DataFrame:
    """(c, j, importance): mean sizes over rows."""
    return phi.select("c", F.posexplode("phi").alias("j", "phi")).groupBy("c", "j").agg(F.avg(F.abs("phi")).alias("importance"))


def signed_parts(phi: DataFrame) -> DataFrame:
    """Positive and negative parts of each row and class, and sizes over the largest of them, as arrays."""
    size = F.transform("phi", F.abs)
    strength = let(F.array_max(size), lambda most: F.transform("phi", lambda v: F.coalesce(F.try_divide(F.abs(v), most), F.lit(0.0))))
    return phi.select("id", "c", F.transform("phi", lambda v: F.greatest(v, F.lit(0.0))).alias("positive"), F.transform("phi", lambda v: F.abs(F.least(v, F.lit(0.0)))).alias("negative"), strength.alias("strength"))


def correct_first(scored: DataFrame, k: int, balanced: bool = True) -> DataFrame:
    """The first k correct rows of each class by id; balanced, no class gives more than the class with fewest."""
    from pyspark.sql import Window

    right = scored.filter(F.col("pred") == F.col("label")).select("id", "label", "pred")
    # k is small: a class's first rows are picked in each task first, so that no task gets a whole class
    ranked = right.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("label", "_part").orderBy("id"))).filter(F.col("_r") <= k)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter(F.col("_r") <= k)
    if balanced:
        least = first.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
        first = first.crossJoin(F.broadcast(least)).filter(F.col("_r") <= F.col("_least"))
    return first.select("id", "label", "pred", F.col("_r").cast("int").alias("rank"))


def red_overlay(image: Column, heat: Column) -> Column:
    return F.zip_with(image, heat, lambda i, h: F.greatest(F.lit(0.0), F.least(F.lit(1.0), i + 0.5 * h)))


def square_gradient(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Gradients of the logits (classes, n, width) at points, of a linear model over features and their squares."""
    half = w.shape[1] // 2
    return lambda points: w[:, None, :half] + 2 * w[:, None, half:] * points[None]


def expected_gradients(rows: DataFrame, background: DataFrame, gradient: Callable[[np.ndarray], np.ndarray], paths: int = 1, seed: int | str = 42) -> DataFrame:
    """(id, c, phi): attributions of each feature to each class's logit, for any model whose gradients are known at a point.

    They are the mean, over all rows of the background and `paths` points on the way from each to the row, of the gradient
    there times the way. The points lie in equal parts of the way, where in each is drawn from a hash of both ids, so results
    don't depend on partitions. A linear model's are exact; summed, they tend to the logit less its mean over the background as
    paths grow. The background (id, features) is small by intention, and goes to every task; a row's points never leave it.
    """
    base = background.select("id", "features").orderBy("id").collect()
    if not base:
        raise ValueError("the background has no rows")
    ids, points = [r["id"] for r in base], np.array([r["features"] for r in base], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            every = matrix(batch.column("features"))
            step = max(1, STEP_CELLS // (len(ids) * paths * every.shape[1]))
            for at in range(0, len(every), step):
                x, names = every[at : at + step], batch.column("id").slice(at, step)
                draws = np.array([[[(k + uniform_of(seed, f"{i}_{b}_{k}")) / paths for k in range(paths)] for b in ids] for i in names.to_pylist()])
                way = x[:, None, :] - points[None]  # n, background, width
                there = points[None, :, None] + draws[..., None] * way[:, :, None]
                g = gradient(there.reshape(-1, x.shape[1])).reshape(-1, *there.shape)
                phi = np.einsum("cnbkj,nbj->ncj", g, way, optimize=True) / (len(ids) * paths)
                n, classes, width = phi.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n * classes + 1, dtype=np.int32) * width), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(n), classes))), pa.array(np.tile(np.arange(classes, dtype=np.int32), n)), lists], names=["id", "c", "phi"])

    return rows.select(F.col("id").cast("long"), "features").mapInArrow(run, "id long, c int, phi array<double>")

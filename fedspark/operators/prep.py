"""Preparing images: axis and slice choice, normalisation, quantising, resizing, augmentation, labels. All within a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_gauss, hash_uniform
from ..functions.vectors import let, mean, stddev


def longest_axis(shape: Column) -> Column:
    """From 0; the first of equals."""
    return (F.array_position(shape, F.array_max(shape)) - 1).cast("int")


def slice_indices(n: Column) -> Column:
    """The middle and a sixth to either side, within [0, n - 1]."""
    mid, step = F.floor(n / 2), F.floor(n / 6)
    return F.transform(F.array(mid, mid - step, mid + step), lambda k: F.greatest(F.lit(0).cast("long"), F.least(k, n.cast("long") - 1)).cast("int"))


def zscore_clip(x: Column, bound: float = 3.0) -> Column:
    """Deviations from the mean in population standard deviations, clipped; zeros where all values are equal."""
    scaled = lambda v, m, s: F.when(s > 0, F.greatest(F.least((v - m) / s, F.lit(bound)), F.lit(-bound))).otherwise(0.0)
    return let(mean(x), lambda m: let(stddev(x), lambda s: F.transform(x, lambda v: scaled(v, m, s))))


def minmax(x: Column, guard: float = 1e-8) -> Column:
    return let(F.array_min(x), lambda low: let(F.array_max(x) - low + guard, lambda width: F.transform(x, lambda v: (v - low) / width)))


def quantize(x: Column, levels: int = 255) -> Column:
    return F.transform(x, lambda v: F.floor(v * levels) / float(levels))


def bilinear_weights(source: int, target: int) -> list[list[float]]:
    """Rows of weights over the source's pixels, with pixel centres at halves and edges repeated."""
    out = []
    for t in range(target):
        at = min(max((t + 0.5) * source / target - 0.5, 0.0), source - 1.0)
        low = int(at)
        row = [0.0] * source
        row[low] += 1 - (at - low)
        row[min(low + 1, source - 1)] += at - low
        out.append(row)
    return out


def lanczos_weights(source: int, target: int, lobes: int = 3) -> list[list[float]]:
    """Rows of weights over the source's pixels by a windowed sinc, wider where the image shrinks; each row sums to 1."""
    scale = source / target
    wide = max(scale, 1.0)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    out = []
    for t in range(target):
        centre = (t + 0.5) * scale
        low, high = max(0, int(centre - lobes * wide + 0.5)), min(source, int(centre + lobes * wide + 0.5))
        row = [0.0] * source
        for i in range(low, high):
            x = (i + 0.5 - centre) / wide
            row[i] = sinc(x) * sinc(x / lobes) if abs(x) < lobes else 0.0
        total = sum(row)
        out.append([w / total for w in row])
    return out


#: Pixels that one step of resizing makes, about.
STEP_PIXELS = 1 << 21
WEIGHTS = {"bilinear": bilinear_weights, "lanczos": lanczos_weights}


def resize(rows: DataFrame, column: str, source: tuple[int, int], target: tuple[int, int], method: str = "bilinear", summary: Callable[[np.ndarray], list[np.ndarray]] | None = None, kinds: str = "") -> DataFrame:
    """Images (arrays of pixels, rows first) in a column, resized from one height and width to another.

    Two matrix products for each run of images, of STEP_PIXELS pixels at most: one over the rows' weights and one over the
    columns'. A null image stays null, and one of another size becomes null.

    With a summary, large images don't leave the task that makes them: in the column's place stand the columns `kinds`
    (names and types) that it gives of resized images (one a row, all pixels), null where the image would be.
    """
    down, across = (np.array(WEIGHTS[method](s, t)) for s, t in zip(source, target))
    pixels, names = source[0] * source[1], rows.columns
    at = names.index(column)

    step = max(1, STEP_PIXELS // (target[0] * max(target[1], source[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, step) for b in batches for k in range(0, len(b), step)):
            images = batch.column(at)
            fits = pc.fill_null(pc.equal(pc.list_value_length(images), pixels), False)
            given = images.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *source)
            made = (down @ given @ across.T).reshape(len(given), target[0] * target[1])
            ok = fits.to_numpy(zero_copy_only=False)
            if summary:
                at_made = pa.array(np.cumsum(ok) - 1, mask=~ok)
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), *(pa.array(x).take(at_made) for x in summary(made))], names=schema.names)
                continue
            ends = np.concatenate(([0], np.cumsum(ok))) * made.shape[1]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.ravel()), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([found if k == at else c for k, c in enumerate(batch.columns)], names=names)

    if summary:
        schema = T.StructType([*(f for f in rows.schema if f.name != column), *T._parse_datatype_string(kinds)])
    else:
        schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == column else f.dataType) for f in rows.schema])
    return rows.mapInArrow(run, schema)


def flip_rows(image: Column, width: int) -> Column:
    """Left and right exchanged."""
    return F.transform(F.sequence(F.lit(0), F.size(image) - 1), lambda p: F.element_at(image, (F.floor(p / width) * width + (width - 1 - p % width) + 1).cast("int")))


def augment_flip(rows: DataFrame, width: int, seed: int = 42) -> DataFrame:
    return rows.withColumn("features", F.when(hash_uniform(f"{seed}flip") < 0.5, flip_rows(F.col("features"), width)).otherwise(F.col("features")))


def augment_noise(rows: DataFrame, scale: float = 0.02, seed: int = 42) -> DataFrame:
    """Noise on half of the rows, then clamped to [0, 1]."""
    key = lambda p: F.concat(F.col("id").cast("string"), F.lit("_"), p.cast("string"))
    noisy = F.transform("features", lambda v, p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + scale * hash_gauss(seed, key(p)))))
    return rows.withColumn("features", F.when(hash_uniform(f"{seed}noise") < 0.5, noisy).otherwise(F.col("features")))


def decode_label(label: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def one_hot(label: Column, classes: int) -> Column:
    return F.array(*(F.when(label == c, 1).otherwise(0) for c in range(classes)))


def overlay(image: Column, heat: Column, alpha: float = 0.4) -> Column:
    return F.zip_with(image, heat, lambda i, h: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - alpha) * i + alpha * h)))


def channel_mean(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weights for one input channel: the mean over the channels."""
    return weights.groupBy(*keys).agg(F.avg("w").alias("w"))

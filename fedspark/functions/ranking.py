"""Ranks and running sums over whole tables without sending all rows to one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import hash_hex


#: Rows of a bucket, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1024


def sketched(df: DataFrame, value: str, per_bucket: int = BUCKET_ROWS, most: int = MOST_BUCKETS) -> Column:
    """A bucket for running() that doesn't fall as value rises: ranges that a quantile sketch of df's values bounds, so that
    crowded values get narrow ones. Equal values share a bucket. One scan; the driver gets `most` numbers at most."""
    row = df.agg(F.count(value).alias("n"), F.percentile_approx(value, [k / most for k in range(1, most)], 10 * most).alias("cuts")).first()
    wanted = min(most, -(-row["n"] // per_bucket))
    if wanted < 2:
        return F.lit(0)
    found = row["cuts"]
    cuts = sorted({found[round(k * most / wanted) - 1] for k in range(1, wanted)})

    def tree(low: int, high: int) -> Column:
        """The number of cuts below a value that lies above cuts[:low] and not above cuts[high:]."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(value) > cuts[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def running(df: DataFrame, bucket: Column, order: list, sums: dict[str, Column | str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name of sums, the sum up to and with the row's peers, in the order of `bucket` and then `order`.

    bucket must not fall as order rises. Null keys are keys, and rows without a bucket stand before all others. Each bucket is one window; what earlier buckets hold is added from a table with
    a row for each bucket.
    """
    df = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", F.col(value) if isinstance(value, str) else value)
    totals = df.groupBy(*keys, "_bucket").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    of = [F.col(k).alias(f"_of_{k}") for k in (*keys, "_bucket")]
    offsets = totals.select(*of, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_bucket")))
    out = df.join(offsets, same).drop(*(f"_of_{k}" for k in (*keys, "_bucket")))
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inner))
    return out.drop("_bucket", *(f"_{p}_{n}" for p in "vo" for n in sums))


def hash_rank(df: DataFrame, seed: int | str, name: str = "rn", key: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """1-based rank of each row in the shuffle of hash_hex(seed, key), within keys; key must tell rows apart."""
    df = df.withColumn("_hex", hash_hex(seed, key))
    return running(df, F.substring("_hex", 1, 3), ["_hex"], {name: F.lit(1)}, keys).drop("_hex")

"""Reproducible draws from a hash of (seed, id), the same however the rows are partitioned. They give no privacy."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | str, key: str | Column = "id") -> Column:
    """32 hex digits; their order is a shuffle of the ids."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_uniform(seed: int | str, key: str | Column = "id") -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(hash_hex(seed, key), 1, 8), 16, 10).cast("long").cast("double") / 4294967296.0


def hash_gauss(seed: int | str, key: str | Column = "id") -> Column:
    """A standard normal number by the Box-Muller transform of two uniform ones."""
    u, v = hash_uniform(f"{seed}a", key), hash_uniform(f"{seed}b", key)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)


def uniform_of(seed: int | str, key: int | str) -> float:
    """hash_uniform of one key, outside Spark."""
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def gauss_of(seed: int | str, key: int | str) -> float:
    """hash_gauss of one key, outside Spark."""
    u, v = uniform_of(f"{seed}a", key), uniform_of(f"{seed}b", key)
    return math.sqrt(-2.0 * math.log(1.0 - u)) * math.cos(2.0 * math.pi * v)

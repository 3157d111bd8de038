"""Algebra on arrays within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def stddev(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a)))


def softmax(z: Column) -> Column:
    powers = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(z: Column) -> Column:
    """Index from 0 of the largest value, rounded to nine decimals; the first of equals."""
    return let(F.transform(z, lambda x: F.round(x, 9)), lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))

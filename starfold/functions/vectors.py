"""Vector expressions on array columns that stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-9


def dot(left: Column, right: Column, size: int | None = None) -> Column:
    """Inner product; with a known size it is unrolled and code-generated."""
    if size:
        return reduce(lambda a, b: a + b, (
            left[d].cast("double") * right[d].cast("double") for d in range(size)))
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column, size: int | None = None) -> Column:
    return F.sqrt(dot(vector, vector, size))


def scaled(vector: Column, length: Column) -> Column:
    """The vector divided by a number that is computed once, not per element."""
    return F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, by: x.cast("double") / by)


def unit(vector: Column, size: int | None = None) -> Column:
    length = F.greatest(norm(vector, size), F.lit(NORM_FLOOR))
    return scaled(vector, length)


def cosine(left: Column, right: Column, size: int | None = None) -> Column:
    """Cosine of two vectors, 0 when the first has no length."""
    a, b = norm(left, size), norm(right, size)
    value = dot(left, right, size) / (a * F.greatest(b, F.lit(NORM_FLOOR)))
    return F.when(a < NORM_FLOOR, F.lit(0.0)).otherwise(value)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.cast("double") + b.cast("double"))


def weighted_sum(vector: Column, weight: Column, size: int) -> Column:
    """Aggregate: the sum of weight * vector, one partial sum per dimension.

    Being plain sums it is combined before the shuffle, so a group of any size
    ships one row per map task.
    """
    return F.array(*[F.sum(weight * vector[d].cast("double")) for d in range(size)])


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)

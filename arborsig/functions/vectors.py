"""Column builders for dense vectors as arrays of numbers.  Vectors of different lengths give nulls at the end."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fill(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(value).cast("double"), n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def add_mult(a: Column, b: Column, factor) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double") * F.lit(factor))


def scale(a: Column, factor) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.lit(factor))


def put(a: Column, i: int, value) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.lit(value)).otherwise(x.cast("double")))


def show(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")

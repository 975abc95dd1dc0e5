"""Distances as Column builders, each with a numpy twin for kernels that compare a batch with a set of keys.

A custom distance is an object with the same members.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, functions as F


class Distance(Protocol):
    name: str
    type: str

    def column(self, a: Column, b: Column) -> Column: ...

    def squared(self, d: Column) -> Column: ...

    def rows(self, values) -> np.ndarray: ...

    def matrix(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray: ...

    def square(self, d: np.ndarray) -> np.ndarray: ...


def stacked(values, dtype) -> np.ndarray:
    """Rows of equal length as a matrix."""
    rows = list(values)
    if rows and isinstance(rows[0], np.ndarray):
        return np.concatenate(rows).astype(dtype, copy=False).reshape(len(rows), -1)
    return np.array(rows, dtype=dtype)


def from_arrow(column, dtype) -> np.ndarray:
    """An Arrow array of lists of equal length, without nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("values differ in length")
    return np.ascontiguousarray(flat.astype(dtype, copy=False)).reshape(len(column), -1)


@dataclass(frozen=True)
class Hamming:
    name: str = "hamming"
    type: str = "bigint"

    def column(self, a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    def squared(self, d: Column) -> Column:
        return d * d

    def rows(self, values) -> np.ndarray:
        return stacked(values, np.int64).view(np.uint64)

    def matrix(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if x.shape[1] == 1:
            return np.bitwise_count(x ^ keys[None, :, 0]).astype(np.int64)
        out = np.empty((len(x), len(keys)), np.int64)
        for j, k in enumerate(keys):
            out[:, j] = np.bitwise_count(x ^ k).sum(1, dtype=np.int64)
        return out

    def square(self, d: np.ndarray) -> np.ndarray:
        return d * d


@dataclass(frozen=True)
class EuclideanSq:
    name: str = "euclidean_sq"
    type: str = "double"

    def column(self, a: Column, b: Column) -> Column:
        diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)

    def squared(self, d: Column) -> Column:
        return d

    def rows(self, values) -> np.ndarray:
        return stacked(values, np.float64)

    def matrix(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return ((x[:, None, :] - keys[None, :, :]) ** 2).sum(2)

    def square(self, d: np.ndarray) -> np.ndarray:
        return d


@dataclass(frozen=True)
class Euclidean(EuclideanSq):
    name: str = "euclidean"

    def column(self, a: Column, b: Column) -> Column:
        return F.sqrt(EuclideanSq.column(self, a, b))

    def squared(self, d: Column) -> Column:
        return d * d

    def matrix(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.sqrt(EuclideanSq.matrix(self, x, keys))

    def square(self, d: np.ndarray) -> np.ndarray:
        return d * d


HAMMING, EUCLIDEAN_SQ, EUCLIDEAN = Hamming(), EuclideanSq(), Euclidean()

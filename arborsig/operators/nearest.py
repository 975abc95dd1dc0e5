"""Nearest key of each object, with the lowest index on ties, for the least and the greatest distance alike.

Keys are a model, not data: they are held by the driver and number at most ``MOST_KEYS``.  Up to ``FEW_KEYS`` single-word
keys the search is an expression over a literal array, without join or Python; beyond, an Arrow kernel compares batches
of objects with all keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import HAMMING, Distance

FEW_KEYS, MOST_KEYS = 64, 1_000_000
#: Cells of the distance matrix that a kernel holds at once.
CELLS = 4_000_000


def literal(key: Sequence, distance: Distance) -> Column:
    kind = "bigint" if distance.type == "bigint" else "double"
    return F.array(*[F.lit(x).cast(kind) for x in key])


def nearest_column(obj: Column, keys: Sequence[Sequence], distance: Distance = HAMMING, greatest: bool = False) -> Column:
    """STRUCT<dist, idx> of the nearest of the keys."""
    every = F.array(*[literal(k, distance) for k in keys])
    sign = -1 if greatest else 1
    best = F.array_min(F.transform(every, lambda k, i: F.struct((distance.column(obj, k) * sign).alias("d"), i.alias("idx"))))
    return F.struct((best["d"] * sign).cast(distance.type).alias("dist"), best["idx"].cast("int").alias("idx"))


def arg_nearest(x: np.ndarray, keys: np.ndarray, distance: Distance, greatest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of each row's nearest key."""
    idx, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if distance.type == "bigint" else np.float64)
    step = max(1, CELLS // max(1, keys.size))
    for s in range(0, len(x), step):
        d = distance.matrix(x[s : s + step], keys)
        i = d.argmax(1) if greatest else d.argmin(1)
        idx[s : s + step], dist[s : s + step] = i, d[np.arange(len(i)), i]
    return idx, dist


def nearest(objects: DataFrame, keys: Sequence[Sequence], value: str = "sig", distance: Distance = HAMMING, greatest: bool = False, strategy: str = "auto") -> DataFrame:
    """``objects`` with ``idx`` and ``dist``, the nearest key's number and distance.

    Objects with a null value have nulls.  Without keys it is an error.  ``strategy`` is ``sql``, ``arrow`` or ``auto``.
    """
    if not len(keys):
        raise ValueError("there are no keys to compare with")
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: use a tree of keys")
    small = len(keys) <= FEW_KEYS and len(keys[0]) <= (1 if distance.type == "bigint" else 64)
    if strategy == "sql" or (strategy == "auto" and small):
        near = F.when(F.col(value).isNotNull(), nearest_column(F.col(value), keys, distance, greatest))
        return objects.withColumn("_n", near).select(*objects.columns, F.col("_n.idx").alias("idx"), F.col("_n.dist").alias("dist"))
    shared = objects.sparkSession.sparkContext.broadcast(distance.rows(keys))  # at most MOST_KEYS
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema) + f", idx int, dist {distance.type}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            there = b[value].notna().to_numpy()
            idx, dist = pd.array([None] * len(b), dtype="Int64"), pd.array([None] * len(b), dtype="Int64" if distance.type == "bigint" else "Float64")
            if there.any():
                i, d = arg_nearest(distance.rows(b.loc[there, value]), shared.value, distance, greatest)
                idx[there], dist[there] = i, d
            yield b.assign(idx=idx, dist=dist)

    return objects.mapInPandas(run, schema)


def distances(objects: DataFrame, keys: Sequence[Sequence], value: str = "sig", distance: Distance = HAMMING, squared: bool = False) -> DataFrame:
    """(columns of ``objects``, idx, dist): the distance of each object to each of a few keys."""
    d = lambda k: distance.column(F.col(value), k)
    every = F.array(*[F.struct(F.lit(i).alias("idx"), (distance.squared(d(literal(k, distance))) if squared else d(literal(k, distance))).alias("dist")) for i, k in enumerate(keys)])
    return objects.select("*", F.inline(every))


def sum_squared_error(assigned: DataFrame, by: list[str], distance: Distance = HAMMING) -> DataFrame:
    """(by, count, sse, rmse) from rows with ``dist``."""
    sse = F.sum(distance.squared(F.col("dist")))
    return assigned.groupBy(*by).agg(F.count("dist").alias("count"), sse.alias("sse"), F.sqrt(sse / F.count("dist")).alias("rmse"))

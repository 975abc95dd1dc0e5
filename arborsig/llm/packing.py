"""Packing of items into containers of fixed capacity: first-fit decreasing in randomised groups.

First fit is answered by a tournament tree over the containers' free room (the leftmost leaf with enough room).  The
items are spread over groups by a hash of their key, so that a group is a random sample whose size has a bound; each
group is packed by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
#: Items of a group, on average.  Each group leaves at most one container less than half full.
GROUP_ITEMS = 8192
_SHIFT = 1 << 24  # containers of a group are numbered from group * _SHIFT


class Tournament:
    """First fit over up to ``n`` containers of ``capacity``."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for ``size``, which is taken from it."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.leaves
        room[i] -= size
        while i > 1:
            i >>= 1
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return at


def first_fit_decreasing(sizes, capacity: int = CAPACITY) -> list[int]:
    """The container of each item, in the items' order; larger items are placed first, ties in the order given."""
    sizes = np.asarray(sizes, dtype=np.int64)
    tree, out = Tournament(max(1, len(sizes)), capacity), [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rows: int | None = None) -> DataFrame:
    """(key, piece, start, size, container_id): where each item, or each piece of an item beyond ``capacity``, goes.

    Only an item that alone exceeds the capacity is split, into full pieces and a rest; pieces are numbered from 0 and
    ``start`` is a piece's offset in its item.  Items of size 0, negative or null take no room; they get a container as
    well.  Repeated rows are items of their own.  An empty input gives an empty result.  ``rows`` is the number of items,
    if it is known; without it they are counted, for which ``items`` is worked out once more.
    """
    spark = items.sparkSession
    groups = max(1, -(-(items.count() if rows is None else rows) // group_items))
    kind = items.schema[key].dataType.simpleString()
    pieces = (
        items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_n"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0, greatest(0, (_n - 1) div {capacity}))")))
        .select("_key", F.col("piece").cast("int"), (F.col("piece") * capacity).cast("bigint").alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("piece") * capacity).alias("size"))
        .withColumn("_group", F.pmod(F.xxhash64("_key", "piece", F.lit("pack")), F.lit(groups)))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_key", "piece"], ascending=[False, True, True], kind="stable")
        at = first_fit_decreasing(pdf["size"], capacity)
        pdf["container_id"] = np.asarray(at, dtype=np.int64) + pdf["_group"].to_numpy() * _SHIFT
        return pdf[["_key", "piece", "start", "size", "container_id"]]

    parts = max(spark.sparkContext.defaultParallelism, min(groups, 4096))
    packed = pieces.repartition(min(parts, groups), "_group").groupBy("_group").applyInPandas(run, f"_key {kind}, piece int, start bigint, size bigint, container_id bigint")
    return packed.withColumnRenamed("_key", key)

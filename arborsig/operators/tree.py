"""Trees of keys over objects: greedy descent, statistics by level, roll-ups, pruning, histograms.

The keys are a model held by the driver, at most ``MOST_KEYS`` of them; the objects never are.  A node's id is the path
of its numbers from the root ``r``.  Objects belong to the leaves, the nodes without children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distance import HAMMING, Distance, from_arrow
from .nearest import MOST_KEYS, arg_nearest

ROOT = "r"


@dataclass(frozen=True, slots=True)
class Key:
    node_id: str
    parent_id: str
    level: int
    idx: int
    value: tuple


class Tree:
    """An immutable set of keys; the root has no key."""

    def __init__(self, keys: list[Key], distance: Distance = HAMMING):
        if len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys")
        self.keys = sorted(keys, key=lambda k: (k.level, k.parent_id, k.idx))
        self.distance = distance
        self.by_id = {k.node_id: k for k in self.keys}
        self.children: dict[str, list[Key]] = {}
        for k in self.keys:
            self.children.setdefault(k.parent_id, []).append(k)

    # what a node is and has
    def is_leaf(self, node_id: str) -> bool:
        return node_id not in self.children

    def is_empty(self) -> bool:
        return not self.keys

    def child_keys(self, node_id: str = ROOT) -> list[Key]:
        return self.children.get(node_id, [])

    def size(self, node_id: str = ROOT) -> int:
        return len(self.child_keys(node_id))

    def leaves(self) -> list[Key]:
        return [k for k in self.keys if self.is_leaf(k.node_id)]

    def ancestors(self, node_id: str) -> list[str]:
        """The node and those above it, without the root."""
        out = []
        while node_id != ROOT:
            out.append(node_id)
            node_id = self.by_id[node_id].parent_id
        return out

    def max_level(self) -> int:
        return max((k.level for k in self.keys), default=0)

    def min_level(self) -> int:
        """The level of the highest leaf."""
        return min((k.level for k in self.leaves()), default=0)

    def cluster_count(self, level: int) -> int:
        return sum(k.level == level for k in self.keys)

    # changes
    def with_keys(self, keys: list[Key]) -> "Tree":
        return Tree(keys, self.distance)

    def add(self, parent_id: str, values: list[tuple]) -> "Tree":
        level = 1 if parent_id == ROOT else self.by_id[parent_id].level + 1
        n = max((k.idx for k in self.child_keys(parent_id)), default=-1) + 1
        return self.with_keys(self.keys + [Key(f"{parent_id}.{n + i}", parent_id, level, n + i, tuple(v)) for i, v in enumerate(values)])

    def remove(self, node_ids: set[str]) -> "Tree":
        """Without these nodes and what is below them; the others keep their numbers and order."""
        return self.with_keys([k for k in self.keys if not node_ids.intersection(self.ancestors(k.node_id))])

    def clear(self) -> "Tree":
        return self.with_keys([])

    def update(self, values: dict[str, tuple]) -> "Tree":
        """With new values for the keys named; the others keep theirs."""
        return self.with_keys([replace(k, value=tuple(values[k.node_id])) if k.node_id in values else k for k in self.keys])

    def prune(self, counts: dict[str, int]) -> tuple["Tree", int]:
        """(tree, removals): without keys that have no objects below.  A removed subtree counts once."""
        alive = {a for leaf, n in counts.items() if n for a in self.ancestors(leaf)}
        dead = {k.node_id for k in self.keys if k.node_id not in alive}
        points = sum(self.by_id[d].parent_id == ROOT or self.by_id[d].parent_id in alive for d in dead)
        return self.with_keys([k for k in self.keys if k.node_id in alive]), points

    def visit(self, visitor: Callable[[Key], None], level: int | None = None) -> None:
        """Calls ``visitor`` with each key in pre-order, or only with those of a level."""

        def walk(node_id: str) -> None:
            for k in self.child_keys(node_id):
                if level is None or k.level == level:
                    visitor(k)
                walk(k.node_id)

        walk(ROOT)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(node_id, parent_id, level, idx, key)."""
        kind = "array<bigint>" if self.distance.type == "bigint" else "array<double>"
        return spark.createDataFrame([(k.node_id, k.parent_id, k.level, k.idx, list(k.value)) for k in self.keys], f"node_id string, parent_id string, level int, idx int, key {kind}")

    # objects
    def paths(self, objects: DataFrame, id: str = "id", value: str = "sig") -> DataFrame:
        """(id, value, path): ``path`` is an array of (level, node_id, dist) from the root's child to the leaf.

        At each level the child with the nearest key is taken, the first of equally near ones.  Objects with a null
        value are left out.
        """
        if not self.keys:
            raise ValueError("the tree has no keys")
        spark, distance = objects.sparkSession, self.distance
        shared = spark.sparkContext.broadcast(self._numbered())  # at most MOST_KEYS keys
        rows = objects.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("value"))
        kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "value")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, known = shared.value
            for b in batches:
                if not len(b):
                    continue
                steps = _descent(tree, distance.rows(b["value"]), distance)
                at, dist = np.stack([s[0] for s in steps], 1), np.stack([s[1] for s in steps], 1)
                # an object at a leaf above the lowest level stays there: its path ends at the first repetition
                length = 1 + (at[:, 1:] != at[:, :-1]).sum(1)
                names, dist = known[at], dist.astype(np.int64) if distance.type == "bigint" else dist
                yield pd.DataFrame({"id": b["id"], "value": b["value"], "names": pd.Series([r[:n] for r, n in zip(names, length)], dtype=object), "dists": pd.Series([r[:n] for r, n in zip(dist, length)], dtype=object)})

        out = rows.mapInPandas(run, f"id {kinds[0]}, value {kinds[1]}, names array<string>, dists array<{distance.type}>")
        steps = F.transform(F.arrays_zip("names", "dists"), lambda s, i: F.struct((i + 1).alias("level"), s["names"].alias("node_id"), s["dists"].alias("dist")))
        return out.select("id", "value", steps.alias("path"))

    def _numbered(self) -> tuple[dict, np.ndarray]:
        """({number of a node: (numbers of its children, their keys)}, names by number), for kernels."""
        number: dict[str, int] = {ROOT: 0} | {k.node_id: i + 1 for i, k in enumerate(self.keys)}
        packed = {number[p]: (np.array([number[k.node_id] for k in c]), self.distance.rows([k.value for k in c])) for p, c in self.children.items()}
        return packed, np.array([ROOT, *(k.node_id for k in self.keys)], dtype=object)

    def accumulate(self, objects: DataFrame, value: str = "sig") -> DataFrame:
        """(g, n, w, sse, kind, s): number, squared errors and sums by dimension of the objects by leaf ``g``.

        Descent and sums are one pass over the objects; what is shuffled is bounded by the objects themselves.
        """
        from .prototype import Sums, merged_sums

        distance = self.distance
        shared = objects.sparkSession.sparkContext.broadcast(self._numbered())  # at most MOST_KEYS keys
        bits = distance.type == "bigint"
        rows = objects.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, names = shared.value
            sums = Sums(bits)
            for b in batches:
                if b.num_rows:
                    raw = from_arrow(b.column(0), np.int64 if bits else np.float64)
                    at, dist = _descent(tree, raw.view(np.uint64) if bits else raw, distance)[-1]
                    yield from sums.add(names[at], raw, None, distance.square(dist))
            yield from sums.flush()

        return merged_sums(rows.mapInArrow(run, Sums.SCHEMA), len(self.leaves()))

    def descend(self, objects: DataFrame, id: str = "id", value: str = "sig") -> DataFrame:
        """(id, value, leaf_id, dist): the leaf each object comes to."""
        last = F.element_at("path", -1)
        return self.paths(objects, id, value).select("id", "value", last["node_id"].alias("leaf_id"), last["dist"].alias("dist"))

    def visits(self, objects: DataFrame, id: str = "id", value: str = "sig") -> DataFrame:
        """(level, id, node_id, dist): a row for every level of every object's path."""
        return self.paths(objects, id, value).select("id", F.inline("path")).select("level", "id", "node_id", "dist")


def _descent(tree: dict, x: np.ndarray, distance: Distance) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node, distance from its key) of each object at each level; objects that have come to a leaf stay there."""
    at, dist, live, steps = np.zeros(len(x), np.int64), np.zeros(len(x)), np.arange(len(x)), []
    while len(live):
        order = live[np.argsort(at[live], kind="stable")]
        parents, starts = np.unique(at[order], return_index=True)
        going = []
        for p, s, e in zip(parents.tolist(), starts, [*starts[1:], len(order)]):
            if p in tree:
                who = order[s:e]
                ids, keys = tree[p]
                i, d = arg_nearest(x[who], keys, distance)
                at[who], dist[who] = ids[i], d
                going.append(who)
        live = np.concatenate(going) if going else live[:0]
        if len(live):
            steps.append((at.copy(), dist.copy()))
    return steps


def descend_joined(nodes: DataFrame, objects: DataFrame, levels: int, distance: Distance = HAMMING) -> DataFrame:
    """(id, leaf_id, dist) by joins with a table of nodes of any size, for trees too large for a driver.

    At each level objects meet the children of the node they are at, and keep the nearest.
    """
    at = objects.where(F.col("sig").isNotNull()).select("id", "sig", F.lit(ROOT).alias("leaf_id"), F.lit(None).cast(distance.type).alias("dist"))
    for _ in range(levels):
        children = nodes.select(F.col("parent_id").alias("leaf_id"), "node_id", "idx", "key")
        met = at.join(children, "leaf_id", "left")
        d = distance.column(F.col("sig"), F.col("key"))
        best = F.min(F.struct(d.alias("d"), "idx", "node_id")).alias("b")
        found = met.groupBy("id").agg(F.first("sig").alias("sig"), F.first("leaf_id").alias("old"), F.first("dist").alias("od"), F.min(F.when(F.col("node_id").isNotNull(), F.struct(d.alias("d"), "idx", "node_id"))).alias("b"))
        at = found.select("id", "sig", F.coalesce("b.node_id", "old").alias("leaf_id"), F.coalesce("b.d", "od").alias("dist"))
    return at.select("id", "leaf_id", "dist")


def leaf_stats(assigned: DataFrame, distance: Distance = HAMMING) -> DataFrame:
    """(leaf_id, count, sse) from (leaf_id, dist)."""
    return assigned.groupBy("leaf_id").agg(F.count("*").alias("count"), F.sum(distance.squared(F.col("dist"))).alias("sse"))


def level_stats(tree: Tree, visits: DataFrame) -> DataFrame:
    """(level, parent_id, node_id, rmse, object_count) of every key, from ``Tree.visits``.

    A key without objects has count 0 and an RMSE of NaN.
    """
    seen = visits.groupBy("node_id").agg(F.count("*").alias("n"), F.sum(tree.distance.squared(F.col("dist"))).alias("sse"))
    keys = tree.frame(visits.sparkSession).select("level", "parent_id", "node_id")
    rmse = F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n"))).otherwise(F.lit(float("nan")))
    return keys.join(seen, "node_id", "left").select("level", "parent_id", "node_id", rmse.alias("rmse"), F.coalesce("n", F.lit(0)).alias("object_count"))


def tree_stats(tree: Tree, assigned: DataFrame) -> DataFrame:
    """One row: (objects, clusters, levels, min_level, rmse); ``clusters`` are leaves with objects.

    Without objects, or with a root that is a leaf, the RMSE is 0.
    """
    sums = assigned.agg(F.count("*").alias("objects"), F.countDistinct("leaf_id").alias("clusters"), F.sum(tree.distance.squared(F.col("dist"))).alias("sse"))
    rmse = F.when(F.col("objects") > 0, F.sqrt(F.col("sse") / F.col("objects"))).otherwise(F.lit(0.0))
    return sums.select("objects", "clusters", F.lit(tree.max_level()).alias("levels"), F.lit(tree.min_level()).alias("min_level"), rmse.alias("rmse"))


def level_counts(tree: Tree, spark: SparkSession) -> DataFrame:
    """(level, clusters): the keys of each level, with and without objects."""
    return spark.createDataFrame([(v, tree.cluster_count(v)) for v in range(1, tree.max_level() + 1)], "level int, clusters int")


def leaf_counter(tree: Tree, spark: SparkSession) -> DataFrame:
    """One row: (leaves), empty ones included."""
    return spark.createDataFrame([(len(tree.leaves()),)], "leaves int")


def size_histogram(tree: Tree, assigned: DataFrame, largest: int) -> DataFrame:
    """(size, leaves) for every size from 0 to ``largest``, or to the largest leaf's if that is more."""
    spark = assigned.sparkSession
    sizes = tree.frame(spark).join(spark.createDataFrame([(k.node_id,) for k in tree.leaves()], "node_id string"), "node_id", "left_semi").select(F.col("node_id").alias("leaf_id"))
    counted = sizes.join(assigned.groupBy("leaf_id").count(), "leaf_id", "left").select(F.coalesce("count", F.lit(0)).alias("size")).groupBy("size").agg(F.count("*").alias("leaves"))
    rows = [tuple(r) for r in counted.collect()]  # at most as many as leaves
    counted = spark.createDataFrame(rows, "size bigint, leaves bigint")
    return spark.range(max([largest, *(r[0] for r in rows)]) + 1).select(F.col("id").alias("size")).join(counted, "size", "left").select("size", F.coalesce("leaves", F.lit(0)).alias("leaves"))


def leaf_counts(assigned: DataFrame) -> dict[str, int]:
    """Objects by leaf, as many entries as there are leaves."""
    return {r["leaf_id"]: r["count"] for r in assigned.groupBy("leaf_id").count().collect()}

"""The K-tree: an online tree in which leaves split as objects are added, for each shard of the objects.

Insertion is sequential by nature: a shard is built by one task, which holds the shard's objects, so a shard has at most
``MOST_SHARD`` of them.  One shard is exact; several are independent trees under one root, which is an approximation.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.distance import HAMMING, Distance
from .prototype import majority_words
from .tree import ROOT, Key, Tree

MOST_SHARD = 2_000_000


class _Node:
    __slots__ = ("leaf", "keys", "children", "names", "count")

    def __init__(self, leaf: bool):
        self.leaf, self.keys, self.children, self.names, self.count = leaf, [], [], [], 0


class KTreeKernel:
    """The tree of one shard.  ``delay``: paths are updated at every so many insertions only."""

    def __init__(self, order: int, distance: Distance = HAMMING, max_iters: int = 2, delay: int = 1, seed: int = 42):
        if order < 2:
            raise ValueError("a node needs room for two keys")
        self.order, self.distance, self.max_iters, self.delay, self.rng = order, distance, max_iters, delay, random.Random(seed)
        self.root, self.added = _Node(True), 0

    def _mean(self, values: list, weights: list[int]) -> tuple:
        w = np.asarray(weights, dtype=np.float64)
        if self.distance.type == "bigint":
            x = np.unpackbits(np.array(values, dtype="<i8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
            return majority_words(w @ x, w.sum())
        return tuple(w @ np.array(values, dtype=np.float64) / w.sum())

    def _nearest(self, value, keys: list) -> int:
        return int(self.distance.matrix(self.distance.rows([value]), self.distance.rows(keys))[0].argmin())

    @staticmethod
    def count(node: _Node) -> int:
        """The number of objects below a node."""
        return node.count

    @staticmethod
    def _weights(node: _Node) -> list[int]:
        """How many objects each of a node's keys stands for."""
        return [1] * len(node.keys) if node.leaf else [c.count for c in node.children]

    def _halves(self, values: list) -> list[list[int]]:
        """Two groups of numbers of values by 2-means; nearly equal random halves if that leaves one empty."""
        picks = self.rng.sample(range(len(values)), 2)
        keys = [values[p] for p in picks]
        groups: list[list[int]] = [[], []]
        for _ in range(max(1, self.max_iters)):
            side = self.distance.matrix(self.distance.rows(values), self.distance.rows(keys)).argmin(1)
            groups = [np.flatnonzero(side == s).tolist() for s in (0, 1)]
            if not groups[0] or not groups[1]:
                mixed = self.rng.sample(range(len(values)), len(values))
                return [sorted(mixed[: len(mixed) // 2]), sorted(mixed[len(mixed) // 2 :])]
            keys = [self._mean([values[i] for i in g], [1] * len(g)) for g in groups]
        return groups

    def _split(self, node: _Node) -> tuple[list, list[_Node]]:
        keys, halves = [], []
        for g in self._halves(node.keys):
            half = _Node(node.leaf)
            half.keys = [node.keys[i] for i in g]
            if node.leaf:
                half.names = [node.names[i] for i in g]
            else:
                half.children = [node.children[i] for i in g]
            half.count = sum(self._weights(half))
            keys.append(self._mean(half.keys, self._weights(half)))
            halves.append(half)
        return keys, halves

    def _push(self, node: _Node, name, value) -> tuple[list, list[_Node]] | None:
        node.count += 1
        if node.leaf:
            node.keys.append(value)
            node.names.append(name)
        else:
            i = self._nearest(value, node.keys)
            parts = self._push(node.children[i], name, value)
            if parts:
                node.keys[i : i + 1], node.children[i : i + 1] = parts
            elif self.added % self.delay == 0:
                child = node.children[i]
                node.keys[i] = self._mean(child.keys, self._weights(child))
        return self._split(node) if len(node.keys) > self.order else None

    def add(self, name, value) -> None:
        parts = self._push(self.root, name, tuple(value))
        if parts:
            self.root = _Node(False)
            self.root.keys, self.root.children = parts
            self.root.count = sum(self._weights(self.root))
        self.added += 1

    def rows(self, prefix: str) -> tuple[list[tuple], list[tuple]]:
        """(keys as (node_id, parent_id, level, idx, value), members as (name, leaf_id))."""
        keys, members = [], []

        def walk(node: _Node, at: str, level: int) -> None:
            if node.leaf:
                members.extend((n, at) for n in node.names)
                return
            for i, (k, c) in enumerate(zip(node.keys, node.children)):
                keys.append((f"{at}.{i}", at, level, i, k))
                walk(c, f"{at}.{i}", level + 1)

        walk(self.root, prefix, prefix.count(".") + 1)
        return keys, members


def ktree(objects: DataFrame, order: int, max_iters: int = 2, delay: int = 1, shards: int = 1, distance: Distance = HAMMING, seed: int = 42, id: str = "id", value: str = "sig") -> tuple[DataFrame, DataFrame]:
    """(nodes, assigned): (node_id, parent_id, level, idx, key) and (id, leaf_id).

    Objects are added in the order of their ids.  With several shards the first level holds the shards' trees.  Null
    values are left out.
    """
    kind = "array<bigint>" if distance.type == "bigint" else "array<double>"
    rows = objects.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("value"), F.pmod(F.xxhash64(F.col(id)), F.lit(shards)).alias("shard"))
    id_kind = rows.schema["id"].dataType.simpleString()

    def build(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > MOST_SHARD:
            raise ValueError(f"a shard has {len(p)} objects: use more shards")
        p = p.sort_values("id", kind="stable")
        tree = KTreeKernel(order, distance, max_iters, delay, seed)
        for name, v in zip(p["id"], p["value"]):
            tree.add(name, v.tolist())
        keys, members = tree.rows(ROOT if shards == 1 else f"{ROOT}.{p['shard'].iloc[0]}")
        a = pd.DataFrame([(None, *k[:4], list(k[4])) for k in keys], columns=["id", "node_id", "parent_id", "level", "idx", "key"])
        b = pd.DataFrame([(n, leaf, None, None, None, None) for n, leaf in members], columns=["id", "node_id", "parent_id", "level", "idx", "key"])
        return pd.concat([x for x in (a, b) if len(x)]).astype({"level": "Int32", "idx": "Int32", "id": p["id"].dtype.name.replace("int64", "Int64")})

    from ..session import durable

    both = durable(rows.groupBy("shard").applyInPandas(build, f"id {id_kind}, node_id string, parent_id string, level int, idx int, key {kind}"))
    return both.where("level is not null").drop("id"), both.where("level is null").select("id", F.col("node_id").alias("leaf_id"))


def as_tree(nodes: DataFrame, distance: Distance = HAMMING) -> Tree:
    """The keys as a tree held by the driver, for descent, pruning and new keys as with other trees."""
    return Tree([Key(r["node_id"], r["parent_id"], r["level"], r["idx"], tuple(r["key"])) for r in nodes.collect()], distance)

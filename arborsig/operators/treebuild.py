"""Building trees of keys: top-down (TSVQ), and batch EM steps over trees with their objects in the leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import HAMMING, Distance
from ..session import durable
from .kmeans import KMeans
from .nearest import arg_nearest
from .prototype import accumulate, majority_words
from .tree import ROOT, Key, Tree, leaf_counts


def split_levels(objects: DataFrame, fan_outs: list[int], max_iters: int, distance: Distance = HAMMING, seed: int = 42, id: str = "id", value: str = "sig", seeder=None) -> tuple[Tree, DataFrame]:
    """(tree, assigned): a level of keys for each fan-out, by k-means in all nodes of a level at once.

    ``assigned`` has (id, value, leaf_id) as the last rounds of k-means assigned the objects.
    """
    rows = objects.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("value"), F.lit(ROOT).alias("leaf_id"))
    keys: list[Key] = []
    for level, m in enumerate(fan_outs, 1):
        found = KMeans(m, max_iters, distance, seeder, seed=seed).cluster(rows, m, "id", "value", "leaf_id")
        keys += [Key(f"{g}.{i}", g, level, i, v) for g, held in found.keys.items() for i, v in held.items()]
        rows = found.assigned.select("id", "value", F.concat_ws(".", "group", F.col("idx").cast("string")).alias("leaf_id"))
    return Tree(keys, distance), rows


def tsvq(objects: DataFrame, order: int, depth: int, max_iters: int = 2, distance: Distance = HAMMING, seed: int = 42, id: str = "id", value: str = "sig") -> tuple[Tree, DataFrame]:
    """Tree-structured vector quantisation: ``depth`` levels with that of the objects, so one fewer of keys."""
    if depth < 2:
        raise ValueError("a tree of keys needs a depth of at least 2")
    return split_levels(objects, [order] * (depth - 1), max_iters, distance, seed, id, value)


def with_distances(tree: Tree, assigned: DataFrame) -> DataFrame:
    """``assigned`` with ``dist``, the distance of each object from its leaf's key."""
    keys = tree.frame(assigned.sparkSession).select(F.col("node_id").alias("leaf_id"), "key")
    return assigned.join(keys, "leaf_id").select("id", "value", "leaf_id", tree.distance.column(F.col("value"), F.col("key")).alias("dist"))


@dataclass
class EMTree:
    """A tree of keys and the objects of its leaves, (id, value, leaf_id).  Steps return new trees."""

    tree: Tree
    assigned: DataFrame

    @staticmethod
    def seed(objects: DataFrame, splits: list[int], update_means: bool = True, distance: Distance = HAMMING, seed: int = 42, id: str = "id", value: str = "sig") -> "EMTree":
        """Split top-down, a level for each of ``splits``; the means are recalculated once or not at all."""
        return EMTree(*split_levels(objects, splits, 1 if update_means else 0, distance, seed, id, value))

    def replace(self, objects: DataFrame, id: str = "id", value: str = "sig") -> "EMTree":
        """Other objects in place of the present ones, by descent; no key changes."""
        return EMTree(self.tree, durable(self.tree.descend(objects, id, value).select("id", "value", "leaf_id")))

    def rearrange(self) -> "EMTree":
        """The same objects taken out and put in again by descent."""
        return self.replace(self.assigned, "id", "value")

    def prune(self) -> tuple["EMTree", int]:
        """Without keys that have no objects below, and the number of keys removed."""
        tree, _ = self.tree.prune(leaf_counts(self.assigned))
        return EMTree(tree, self.assigned), len(self.tree.keys) - len(tree.keys)

    def rebuild_internal(self) -> "EMTree":
        """New keys from the leaves up: a leaf's is the prototype of its objects, any other's that of its children's
        keys weighted by their numbers of objects."""
        bits = self.tree.distance.type == "bigint"
        values, counts = {}, {}
        for r in accumulate(self.assigned, "leaf_id", "value", bits=bits).collect():  # a row for each leaf
            counts[r["leaf_id"]] = r["count"]
            values[r["leaf_id"]] = majority_words(r["sums"], r["weight"]) if bits else tuple(s / r["weight"] for s in r["sums"])
        import numpy as np

        for level in range(self.tree.max_level() - 1, 0, -1):
            for k in [k for k in self.tree.keys if k.level == level and not self.tree.is_leaf(k.node_id)]:
                under = [(values.get(c.node_id, c.value), counts.get(c.node_id, 0)) for c in self.tree.child_keys(k.node_id)]
                total = sum(n for _, n in under)
                counts[k.node_id] = total
                if not total:
                    continue
                x = np.array([v for v, _ in under])
                w = np.array([n for _, n in under], dtype=np.float64)
                if bits:
                    x = np.unpackbits(x.astype("<i8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
                    values[k.node_id] = majority_words(w @ x, total)
                else:
                    values[k.node_id] = tuple(w @ x / total)
        return EMTree(self.tree.update(values), self.assigned)

    def em_step(self, objects: DataFrame | None = None, id: str = "id", value: str = "sig") -> "EMTree":
        """Descent of the present or other objects, pruning, and new keys."""
        moved = self.rearrange() if objects is None else self.replace(objects, id, value)
        return moved.prune()[0].rebuild_internal()

    def rearrange_internal(self) -> "EMTree":
        """The keys of each level from the second on, with all that is below them, under the nearest key of the level
        above; keys left without children are removed.  No key's value changes."""
        tree, names = self.tree, {}
        for depth in range(2, tree.max_level() + 1):
            tree, moved = _reattach(tree, depth)
            names = {old: moved.get(new, new) for old, new in names.items()} | {k: v for k, v in moved.items() if k not in names.values()}
        mapped = self.assigned
        if names:
            table = self.assigned.sparkSession.createDataFrame(list(names.items()), "leaf_id string, _new string")
            mapped = self.assigned.join(F.broadcast(table), "leaf_id", "left").select("id", "value", F.coalesce("_new", "leaf_id").alias("leaf_id"))
        return EMTree(tree, durable(mapped))


def _reattach(tree: Tree, depth: int) -> tuple[Tree, dict[str, str]]:
    """The tree with the keys of a level attached anew, and the new ids of these and of all below them."""
    order: list[Key] = []
    tree.visit(lambda k: order.append(k) if k.level == depth else None)
    upper = [k for k in tree.keys if k.level < depth]
    above = Tree(upper, tree.distance)
    moved: dict[str, str] = {}
    fresh: list[Key] = []
    count: dict[str, int] = {}
    for k in order:
        at = ROOT
        for _ in range(depth - 1):
            held = above.child_keys(at)
            if not held:
                break
            i, _ = arg_nearest(tree.distance.rows([k.value]), tree.distance.rows([h.value for h in held]), tree.distance)
            at = held[int(i[0])].node_id
        n = count.get(at, 0)
        count[at] = n + 1
        moved[k.node_id] = f"{at}.{n}"
        fresh.append(Key(f"{at}.{n}", at, depth, n, k.value))
    for k in tree.keys:
        if k.level > depth:
            top = next(a for a in tree.ancestors(k.node_id) if tree.by_id[a].level == depth)
            rename = lambda x, t=top: moved[t] + x[len(t) :]
            moved[k.node_id] = rename(k.node_id)
            fresh.append(Key(rename(k.node_id), rename(k.parent_id), k.level, k.idx, k.value))
    alive = {p for k in fresh if k.level == depth for p in above.ancestors(k.parent_id)}
    return tree.with_keys([k for k in upper if k.node_id in alive] + fresh), moved

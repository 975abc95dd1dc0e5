"""k-means, flat and for many groups of objects at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.distance import HAMMING, Distance, from_arrow
from ..session import durable
from .nearest import arg_nearest
from .prototype import Sums, merged_prototypes, prototypes
from .seeding import distance_seeds, order_hash, random_seeds


class Seeder(Protocol):
    """Gives the first keys of each group: {group: [(idx, value)]}; without ``by`` all objects are the group ``""``."""

    def __call__(self, objects: DataFrame, k: int, by: str | None) -> dict[str, list[tuple[int, tuple]]]: ...


class Clusterer(Protocol):
    """Splits the objects of each group into up to ``k`` clusters."""

    def cluster(self, objects: DataFrame, k: int) -> "Clusters": ...


@dataclass
class RandomSeeder:
    seed: int = 42

    def __call__(self, objects: DataFrame, k: int, by: str | None):
        out: dict[str, list] = {}
        for r in random_seeds(objects, k, "id", self.seed, by).select((F.col(by) if by else F.lit("")).alias("by"), "idx", "value").collect():
            out.setdefault(r["by"], []).append((r["idx"], tuple(r["value"])))
        return {g: sorted(v) for g, v in out.items()}


@dataclass
class DistanceSeeder:
    """Draws keys in proportion to their distance from those before; for a single group."""

    seed: int = 42
    tries: int = 1
    distance: Distance = HAMMING

    def __call__(self, objects: DataFrame, k: int, by: str | None):
        groups = [r[0] for r in objects.select(by).distinct().limit(2).collect()] if by else [""]
        if len(groups) > 1:
            raise ValueError("this seeder takes a single group")
        ids = distance_seeds(objects, k, "id", "value", self.distance, self.seed, self.tries)
        values = {r["id"]: tuple(r["value"]) for r in objects.where(F.col("id").isin(ids)).select("id", "value").collect()}
        return {g: [(i, values[x]) for i, x in enumerate(ids)] for g in groups}


@dataclass
class Clusters:
    """``assigned``: (id, value, group, idx, dist) as of the last assignment; ``keys``: {group: {idx: value}} as of the
    last recalculation, without clusters that have no objects."""

    assigned: DataFrame
    keys: dict[str, dict[int, tuple]]
    rounds: int
    converged: bool

    def members(self) -> DataFrame:
        """(id, cluster): clusters numbered without gaps."""
        dense = {(g, i): n for g, k in self.keys.items() for n, i in enumerate(sorted(k))}
        spark = self.assigned.sparkSession
        names = spark.createDataFrame([(g, i, n) for (g, i), n in dense.items()], "group string, idx int, cluster int")
        return self.assigned.join(F.broadcast(names), ["group", "idx"]).select("id", "cluster")


def _packed(keys: dict[str, dict[int, tuple]], distance: Distance) -> dict:
    return {g: ([i for i, _ in sorted(k.items())], distance.rows([v for _, v in sorted(k.items())])) for g, k in keys.items() if k}


def _assign(objects: DataFrame, keys: dict[str, dict[int, tuple]], distance: Distance) -> DataFrame:
    shared = objects.sparkSession.sparkContext.broadcast(_packed(keys, distance))  # the keys of the model
    kinds = [objects.schema[c].dataType.simpleString() for c in ("id", "value")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("group", sort=False):
                idx, rows = shared.value[g]
                i, d = arg_nearest(distance.rows(part["value"]), rows, distance)
                yield pd.DataFrame({"id": part["id"], "value": part["value"], "group": g, "idx": [idx[j] for j in i], "dist": d})

    return objects.select("id", "value", "group").mapInPandas(run, f"id {kinds[0]}, value {kinds[1]}, group string, idx int, dist {distance.type}")


#: Names the row of the objects that have moved.
_MOVED = "\x1fmoved"


def _round(objects: DataFrame, keys: dict, before: dict | None, distance: Distance) -> tuple[dict[str, dict[int, tuple]], int]:
    """(new keys of the clusters that have objects, objects that aren't where the keys ``before`` had them).

    One pass: objects are assigned, compared with where they were, which is worked out again in place of being kept, and
    added up by cluster; what is shuffled are sums.
    """
    bits = distance.type == "bigint"
    shared = objects.sparkSession.sparkContext.broadcast((_packed(keys, distance), _packed(before, distance) if before else None))  # the keys of the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, was = shared.value
        sums, moved = Sums(bits), 0
        for b in batches:
            if not b.num_rows:
                continue
            raw = from_arrow(b.column(1), np.int64 if bits else np.float64)
            x, names = raw.view(np.uint64) if bits else raw, b.column(0).to_pandas()
            for g, at in names.groupby(names, sort=False).indices.items():
                idx, rows = now[g]
                i, d = arg_nearest(x[at], rows, distance)
                i = np.asarray(idx)[i]
                if was:
                    old, rows = was[g]
                    moved += int((np.asarray(old)[arg_nearest(x[at], rows, distance)[0]] != i).sum())
                yield from sums.add([f"{g}\x1f{j}" for j in i.tolist()], raw[at], None, distance.square(d))
        if moved:
            sums.count(_MOVED, moved)
        yield from sums.flush()

    clusters = sum(map(len, keys.values()))
    new: dict[str, dict[int, tuple]] = {g: {} for g in keys}
    moved = 0
    for r in merged_prototypes(objects.select("group", "value").mapInArrow(run, Sums.SCHEMA), clusters, bits).collect():  # a row for each cluster
        if r["g"] == _MOVED:
            moved = r["n"]
            continue
        g, i = r["g"].rsplit("\x1f", 1)
        new[g][int(i)] = tuple(r["key"])
    return new, moved


@dataclass
class KMeans:
    """``max_iters`` 0: seed and assign; 1: and recalculate; more: up to so many rounds, fewer if an assignment changes
    nothing; -1: until then.  Keys without objects stay as they are during the rounds and are left out at the end.

    With ``enforce`` a group that ends with fewer than ``k`` clusters is split at random into k nearly equal ones.
    """

    k: int
    max_iters: int = 100
    distance: Distance = HAMMING
    seeder: Callable | None = None
    enforce: bool = False
    seed: int = 42

    def cluster(self, objects: DataFrame, k: int | None = None, id: str = "id", value: str = "sig", group: str | None = None) -> Clusters:
        """Clusters of the objects, of each ``group`` by itself if given.  Null values are left out."""
        rows = objects.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("value"), (F.col(group) if group else F.lit("")).alias("group"))
        n = k or self.k
        last = keys = {g: dict(v) for g, v in (self.seeder or RandomSeeder(self.seed))(rows, n, "group" if group else None).items()}
        rounds, converged, before = 0, False, None
        if not any(keys.values()):
            return Clusters(_assign(rows.limit(0), {}, self.distance), {}, 0, False)
        used = None
        while rounds == 0 or (not converged and (self.max_iters == -1 or rounds < self.max_iters)):
            if self.max_iters == 0:
                break
            new, moved = _round(rows, keys, before, self.distance)
            converged = before is not None and not moved
            last, before, used = keys, keys, {g: set(v) for g, v in new.items()}
            keys = {g: {**v, **new.get(g, {})} for g, v in keys.items()}
            rounds += 1
        assigned = durable(_assign(rows, last, self.distance))
        if used is None:
            used = {}
            for r in assigned.select("group", "idx").distinct().collect():  # a row for each cluster
                used.setdefault(r["group"], set()).add(r["idx"])
        keys = {g: {i: v for i, v in held.items() if i in used.get(g, ())} for g, held in keys.items()}
        if self.enforce and any(len(v) < n for v in keys.values()):
            short = [g for g, v in keys.items() if len(v) < n]
            forced = durable(self._split(rows.where(F.col("group").isin(short)), n))
            fresh: dict[str, dict[int, tuple]] = {g: {} for g in short}
            bits = self.distance.type == "bigint"
            table = prototypes(forced.withColumn("_g", F.concat_ws("\x1f", "group", F.col("idx").cast("string"))), "_g", "value", bits=bits)
            for r in table.select("_g", "key").collect():  # a row for each cluster
                g, i = r["_g"].rsplit("\x1f", 1)
                fresh[g][int(i)] = tuple(r["key"])
            keys.update(fresh)
            kind = "array<bigint>" if bits else "array<double>"
            table = rows.sparkSession.createDataFrame([(g, i, list(v)) for g in short for i, v in fresh[g].items()], f"group string, idx int, key {kind}")
            moved = forced.join(F.broadcast(table), ["group", "idx"]).select("id", "value", "group", "idx", self.distance.column(F.col("value"), F.col("key")).alias("dist"))
            assigned = durable(assigned.where(~F.col("group").isin(short)).unionByName(moved))
        return Clusters(assigned, keys, rounds, converged)

    def _split(self, rows: DataFrame, n: int) -> DataFrame:
        """``rows`` with ``idx``: each group in n parts at random, equal but for one object in groups that one task can
        order, nearly equal by a hash in larger ones."""
        sizes = rows.groupBy("group").agg(F.count("*").alias("_n"))  # a row a group
        sized = rows.join(F.broadcast(sizes), "group")
        few = sized.where(F.col("_n") <= ORDERED).withColumn("idx", F.ntile(n).over(Window.partitionBy("group").orderBy(order_hash("id", self.seed), "id")) - 1)
        many = sized.where(F.col("_n") > ORDERED).withColumn("idx", F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(n)).cast("int"))
        return few.unionByName(many).drop("_n")


#: Objects of a group that are ordered to split it in equal parts.
ORDERED = 100_000


def rmse(clusters: Clusters, distance: Distance = HAMMING) -> float:
    """Root of the mean squared distance of the objects, as last assigned, from the keys as last recalculated."""
    spark = clusters.assigned.sparkSession
    kind = "array<bigint>" if distance.type == "bigint" else "array<double>"
    table = spark.createDataFrame([(g, i, list(v)) for g, held in clusters.keys.items() for i, v in held.items()], f"group string, idx int, key {kind}")
    d = distance.squared(distance.column(F.col("value"), F.col("key")))
    r = clusters.assigned.join(F.broadcast(table), ["group", "idx"]).agg(F.sqrt(F.sum(d) / F.count("*")).alias("r")).first()
    return r["r"] if r["r"] is not None else float("nan")

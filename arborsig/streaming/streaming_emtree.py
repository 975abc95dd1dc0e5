"""The streaming EM-tree: a tree of keys through which objects flow without being kept.

The state between batches are accumulators of the leaves: counts and sums of squared errors, a row a leaf held by the
driver, and sums by dimension, which stay in a table in the shared folder however large the tree is.  New keys are worked
out where the sums are; only keys come to the driver.  ``MiniBatches`` runs it under Structured Streaming.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prototype import INTS, merged_prototypes, merged_sums
from ..operators.tree import Tree
from ..session import durable, stored


@dataclass
class Accumulator:
    count: int = 0
    sse: float = 0


@dataclass
class StreamingEMTree:
    tree: Tree
    acc: dict[str, Accumulator] = field(default_factory=dict)
    #: The sums by dimension of the leaves, a table for each insertion since the last update.
    parts: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.tree.is_empty():
            raise ValueError("a streaming tree needs a seed tree with at least one level of keys")

    def insert(self, objects: DataFrame, id: str = "id", value: str = "sig") -> int:  # ids play no part
        """Adds the objects to the leaves they descend to; returns their number."""
        n, sums = 0, stored(self.tree.accumulate(objects, value))
        for leaf, count, sse in sums.select("g", "n", "sse").toPandas().itertuples(index=False):  # a row a leaf
            a = self.acc.setdefault(leaf, Accumulator())
            a.count, a.sse, n = a.count + int(count), a.sse + sse, n + int(count)
        if n:
            self.parts.append(sums)
        return n

    def sums(self) -> DataFrame | None:
        """(g, n, w, sse, kind, s) of the leaves with objects that were inserted; None without any."""
        if not self.parts:
            return None
        if len(self.parts) > 1:
            both = self.parts[0]
            for p in self.parts[1:]:
                both = both.unionByName(p)
            self.parts = [stored(merged_sums(both, len(self.tree.leaves())))]
        return self.parts[0]

    def visit(self, objects: DataFrame, id: str = "id", value: str = "sig", count: bool = True) -> DataFrame:
        """(level, id, node_id, dist) of every object at every level.  Counts and errors are added, sums by bit not."""
        paths = durable(self.tree.paths(objects, id, value))
        if count:
            last = F.element_at("path", -1)
            d = self.tree.distance
            leaves = paths.select(last["node_id"].alias("leaf_id"), last["dist"].alias("dist")).groupBy("leaf_id")
            for r in leaves.agg(F.count("*").alias("n"), F.sum(d.squared(F.col("dist"))).alias("sse")).collect():  # a row a leaf
                a = self.acc.setdefault(r["leaf_id"], Accumulator())
                a.count, a.sse = a.count + r["n"], a.sse + r["sse"]
        return paths.select("id", F.inline("path")).select("level", "id", "node_id", "dist")

    def _rolled(self) -> dict[str, Accumulator]:
        total: dict[str, Accumulator] = {}
        for leaf, a in self.acc.items():
            if leaf not in self.tree.by_id:
                continue
            for node in self.tree.ancestors(leaf):
                t = total.setdefault(node, Accumulator())
                t.count, t.sse = t.count + a.count, t.sse + a.sse
        return total

    def update(self) -> None:
        """Every key of every level becomes the prototype of all objects below it; keys without objects stay."""
        sums, new = self.sums(), {}
        if sums is None:
            return
        bits = self.tree.distance.type == "bigint"
        depths = {k.level for k in self.tree.leaves()}
        at = stored(sums) if len(depths) > 1 or max(depths) > 2 else sums
        ids = sorted({k.level for k in self.tree.keys}, reverse=True)
        # a node's sums are those of its leaves: names are cut to each level's length, and added up from level to level
        for level in ids:
            cut = F.substring_index("g", ".", level + 1)
            here = at.select(F.when(F.size(F.split("g", "[.]")) > level + 1, cut).otherwise(F.col("g")).alias("g"), "n", "w", "sse", "kind", "s")
            keys = merged_prototypes(here.where(F.size(F.split("g", "[.]")) == level + 1), self.tree.cluster_count(level), bits)
            new |= {r["g"]: tuple(r["key"]) for r in keys.select("g", "key").collect() if r["g"] in self.tree.by_id}  # keys only
            if level > 1:
                at = stored(merged_sums(here, self.tree.cluster_count(level)))
        self.tree = self.tree.update(new)

    def prune(self) -> int:
        """Removes keys without objects below; a removed subtree counts once."""
        self.tree, removed = self.tree.prune({leaf: a.count for leaf, a in self.acc.items()})
        return removed

    def clear(self) -> None:
        self.acc, self.parts = {}, []

    def object_count(self) -> int:
        return sum(a.count for a in self.acc.values())

    def rmse(self) -> float:
        n = self.object_count()
        return (sum(a.sse for a in self.acc.values()) / n) ** 0.5 if n else float("nan")

    def cluster_stats(self, spark: SparkSession) -> DataFrame:
        """(level, parent_id, node_id, rmse, object_count) of every key; NaN for keys without objects."""
        rolled = self._rolled()
        rows = []
        for k in self.tree.keys:
            a = rolled.get(k.node_id, Accumulator())
            rows.append((k.level, k.parent_id, k.node_id, float((a.sse / a.count) ** 0.5) if a.count else float("nan"), a.count))
        return spark.createDataFrame(rows, "level int, parent_id string, node_id string, rmse double, object_count bigint")

    def accumulators(self, spark: SparkSession) -> DataFrame:
        """(leaf_id, dim, ones) of the leaves that have sums."""
        sums = self.sums()
        if sums is None:
            return spark.createDataFrame([], "leaf_id string, dim int, ones bigint")

        def unpacked(batches):
            for p in batches:
                yield pd.DataFrame({"leaf_id": p["g"], "s": [np.frombuffer(s, dtype="<i4" if k == INTS else "<f8").astype(np.int64) for k, s in zip(p["kind"], p["s"])]})

        return sums.select("g", "kind", "s").mapInPandas(unpacked, "leaf_id string, s array<bigint>").select("leaf_id", F.posexplode("s").alias("dim", "ones"))

    def report(self, spark: SparkSession, removed: int = 0) -> DataFrame:
        """(level, clusters, objects, rmse, removed), a row a level."""
        rows = [(v, self.tree.cluster_count(v), self.object_count(), float(self.rmse()), removed) for v in range(1, self.tree.max_level() + 1)]
        return spark.createDataFrame(rows, "level int, clusters int, objects bigint, rmse double, removed int")


def insert_prune_report(stream: StreamingEMTree, objects: DataFrame, id: str = "id", value: str = "sig") -> DataFrame:
    """A pass without new keys: insert, prune, report."""
    stream.insert(objects, id, value)
    return stream.report(objects.sparkSession, stream.prune())


def insert_write_clusters(stream: StreamingEMTree, objects: DataFrame, id: str = "id", value: str = "sig") -> tuple[DataFrame, DataFrame]:
    """(visits, stats) of a final pass over the objects, pruned."""
    visits = stream.visit(objects, id, value)
    stream.prune()
    return visits, stream.cluster_stats(objects.sparkSession)


def run_passes(stream: StreamingEMTree, objects: DataFrame, passes: int, id: str = "id", value: str = "sig") -> list[DataFrame]:
    """So many passes of insert, prune, report, update, clear; the reports."""
    reports = []
    for _ in range(passes):
        reports.append(insert_prune_report(stream, objects, id, value))
        stream.update()
        stream.clear()
    return reports


def run_batches(stream: StreamingEMTree, objects: DataFrame, batch_rows: int, id: str = "id", value: str = "sig") -> int:
    """One pass in batches of exactly ``batch_rows`` objects in the order of their ids, with new keys after each.

    Accumulators go on from batch to batch and are cleared at the end of the pass.  Returns the number of batches.
    """
    n = objects.count()
    cuts = range(0, n, batch_rows)
    rows = objects
    if len(cuts) > 1:
        # numbers by range: rows are counted by sorted partition first, so that no task orders them all
        ordered = objects.repartitionByRange(max(2, objects.sparkSession.sparkContext.defaultParallelism), id).sortWithinPartitions(id)
        ordered = durable(ordered.withColumn("_p", F.spark_partition_id()))
        sizes = {r["_p"]: r["count"] for r in ordered.groupBy("_p").count().collect()}
        before, at = {}, 0
        for p in sorted(sizes):
            before[p], at = at, at + sizes[p]
        spark = objects.sparkSession
        offsets = F.broadcast(spark.createDataFrame(list(before.items()), "_p int, _o bigint"))  # a row a partition
        numbered = ordered.join(offsets, "_p").withColumn("_b", F.floor((F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(id)) - 1) / batch_rows).cast("int"))
        rows = stored(numbered.drop("_o", "_p"), by="_b")  # a folder a batch, so that a batch reads its own rows only
    for i, _ in enumerate(cuts):
        part = rows.where(F.col("_b") == i) if len(cuts) > 1 else rows
        stream.insert(part, id, value)
        stream.update()
    stream.clear()
    return len(cuts)


class MiniBatches:
    """Runs a streaming tree over a streaming DataFrame, with new keys after each micro-batch.

    The state of the last batch is kept with its number, so that a batch that is delivered again is counted once.
    """

    def __init__(self, stream: StreamingEMTree, id: str = "id", value: str = "sig"):
        self.stream, self.id, self.value, self.last = stream, id, value, -1

    def step(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        self.stream.insert(batch, self.id, self.value)
        self.stream.update()
        self.last = batch_id

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        return source.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

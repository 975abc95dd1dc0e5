"""Whole jobs: clustering runs, streaming passes, experiments, title extraction."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distance import HAMMING, Distance
from ..operators.kmeans import Clusters, KMeans, rmse
from ..operators.ktree import as_tree, ktree
from ..operators.seeding import sample
from ..operators.select import balanced_dims, reduce_dims, subset
from ..operators.tree import tree_stats
from ..operators.treebuild import EMTree, split_levels, tsvq, with_distances
from ..sources.sinks import results_table
from ..sources.warc import extract_titles, read_warc
from ..streaming.streaming_emtree import StreamingEMTree, insert_write_clusters, run_batches, run_passes


def kmeans_job(objects: DataFrame, k: int = 36, max_iters: int = 10) -> Clusters:
    return KMeans(k, max_iters).cluster(objects)


def tsvq_job(objects: DataFrame, order: int = 10, depth: int = 3, max_iters: int = 2) -> DataFrame:
    tree, assigned = tsvq(objects, order, depth, max_iters)
    return tree_stats(tree, with_distances(tree, assigned))


def emtree_job(objects: DataFrame, order: int = 30, depth: int = 3, steps: int = 2) -> EMTree:
    """A tree seeded without means, with a level of keys fewer than ``depth``, and so many EM steps."""
    t = EMTree.seed(objects, [order] * (depth - 1), update_means=False)
    for _ in range(steps):
        t = t.em_step()
    return t


def ktree_job(objects: DataFrame, order: int = 10, max_iters: int = 2, delay: int = 1, shards: int = 1) -> EMTree:
    """A K-tree whose objects are put in again by descent once it is built."""
    nodes, assigned = ktree(objects, order, max_iters, delay, shards)
    rows = assigned.join(objects.select("id", F.col("sig").alias("value")), "id")
    return EMTree(as_tree(nodes), rows).rearrange()


def reduced_dims_job(objects: DataFrame, ids: DataFrame, bits: int, k: int = 36, max_iters: int = 10) -> tuple[Clusters, Clusters]:
    """k-means of a subset with all of the bits, and with the most balanced quarter of them."""
    picked = subset(objects, ids)
    return KMeans(k, max_iters).cluster(picked), KMeans(k, max_iters).cluster(reduce_dims(picked, balanced_dims(picked, bits // 4)))


def seed_stream(objects: DataFrame, ids: DataFrame | None = None, order: int = 10, depth: int = 4, max_iters: int = 0, distance: Distance = HAMMING, seed: int = 42) -> StreamingEMTree:
    """A streaming tree seeded top-down from a subset of the objects."""
    return StreamingEMTree(tsvq(subset(objects, ids) if ids is not None else objects, order, depth, max_iters, distance, seed)[0])


def streaming_emtree_job(objects: DataFrame, ids: DataFrame | None = None, order: int = 10, depth: int = 4, passes: int = 9) -> tuple[StreamingEMTree, DataFrame, DataFrame]:
    """(stream, visits, stats): passes with new keys, then a last one that gives the clusters."""
    stream = seed_stream(objects, ids, order, depth)
    run_passes(stream, objects, passes)
    visits, stats = insert_write_clusters(stream, objects)
    return stream, visits, stats


def mini_batch_job(objects: DataFrame, ids: DataFrame | None = None, order: int = 10, depth: int = 4, batch_rows: int = 100_000, passes: int = 1) -> tuple[StreamingEMTree, DataFrame, DataFrame]:
    """As ``streaming_emtree_job``, with new keys after each batch."""
    stream = seed_stream(objects, ids, order, depth)
    for _ in range(passes):
        run_batches(stream, objects, batch_rows)
    visits, stats = insert_write_clusters(stream, objects)
    return stream, visits, stats


def hybrid_job(objects: DataFrame, sample_size: int, order: int, depth: int = 3, max_iters: int = 2, steps: int = 1, seed: int = 42) -> EMTree:
    """Top-down tree of a sample, then all objects by descent, pruning, new keys, and EM steps."""
    t = EMTree(*tsvq(sample(objects, sample_size, seed=seed), order, depth, max_iters, seed=seed)).replace(objects).prune()[0].rebuild_internal()
    for _ in range(steps):
        t = t.em_step()
    return t


def repeated_kmeans(objects: DataFrame, k: int, trials: int, max_iters: int = 10) -> Clusters:
    """The clusters of least RMSE of several runs with other seeds."""
    runs = [KMeans(k, max_iters, seed=42 + t).cluster(objects) for t in range(trials)]
    return min(runs, key=rmse)


#: The studies' parameters.  Orders of trees are roots of numbers of clusters where so noted.
STUDIES = {
    "convergence": {"methods": ["tsvq", "emtree"], "orders": [10], "depth": 3, "iters": list(range(21))},
    "tsvq_orders": {"methods": ["tsvq"], "orders": [4, 5, 6, 7, 8, 9, 10], "depth": 4, "iters": [2]},
    "emtree_orders": {"methods": ["emtree"], "orders": [4, 5, 6, 7, 8, 10, 12], "depth": 4, "iters": [6]},
    "tsvq_roots": {"methods": ["tsvq"], "clusters": [230, 310, 470, 590, 810, 1010, 1300, 1800, 2900, 4000], "depth": 3, "iters": [10]},
    "emtree_roots": {"methods": ["emtree"], "clusters": [240, 350, 550, 710, 1100, 1550, 2200, 3800, 7500, 11500], "depth": 3, "iters": [10]},
    "kmeans": {"methods": ["kmeans"], "orders": [1300, 1800, 2900, 4000], "depth": 2, "iters": [10]},
    "ktree": {"methods": ["ktree"], "orders": [1000, 750, 500, 400, 300, 250, 200, 150, 100, 75], "depth": 2, "iters": [2]},
    "crawl_ktree": {"methods": ["ktree_delayed"], "orders": [1000], "depth": 2, "iters": [2]},
    "crawl_emtree": {"methods": ["emtree"], "clusters": [110_000], "depth": 3, "iters": [4]},
    "crawl_hybrid": {"methods": ["hybrid"], "clusters": [110_000], "depth": 3, "iters": [4]},
    "ktree_delayed": {"methods": ["ktree_delayed"], "orders": [1000, 750, 500, 400, 300, 250, 185, 138, 85, 65], "depth": 2, "iters": [2]},
}
TRIALS, HYBRID_SAMPLE = 20, 2_000_000


def _run(method: str, objects: DataFrame, m: int, depth: int, iters: int, seed: int) -> tuple[int, float]:
    """(clusters, rmse) of one run."""
    if method == "kmeans":
        found = KMeans(m, iters, seed=seed).cluster(objects)
        return sum(map(len, found.keys.values())), rmse(found)
    if method.startswith("ktree"):
        nodes, assigned = ktree(objects, m, iters, 1000 if method == "ktree_delayed" else 1, seed=seed)
        tree = as_tree(nodes)
        if tree.is_empty():
            return 1, 0.0
        rows = with_distances(tree, assigned.join(objects.select("id", F.col("sig").alias("value")), "id"))
    elif method in ("emtree", "hybrid"):
        t = hybrid_job(objects, HYBRID_SAMPLE, m, depth, steps=iters, seed=seed) if method == "hybrid" else EMTree.seed(objects, [m] * (depth - 1), update_means=False, seed=seed)
        for _ in range(0 if method == "hybrid" else iters):
            t = t.em_step()
        tree, rows = t.tree, with_distances(t.tree, t.assigned)
    else:
        tree, assigned = split_levels(objects, [m] * (depth - 1), iters, seed=seed)
        rows = with_distances(tree, assigned)
    r = tree_stats(tree, rows).first()
    return r["clusters"], r["rmse"]


def experiment_grid(objects: DataFrame, orders: list[int], depth: int = 3, max_iters: list[int] = (2,), trials: int = 2, methods: list[str] = ("tsvq",)) -> DataFrame:
    """(param, trial, clusters, rmse, seconds) of methods over orders and iterations, each with several seeds."""
    rows = []
    for method in methods:
        for m in orders:
            for it in max_iters:
                for t in range(trials):
                    began = time.time()
                    clusters, error = _run(method, objects, m, depth, it, 42 + t)
                    rows.append((f"{method},m={m},iters={it}", t, clusters, error, time.time() - began))
    return objects.sparkSession.createDataFrame(rows, "param string, trial int, clusters bigint, rmse double, seconds double")


def study(objects: DataFrame, name: str, trials: int = TRIALS) -> DataFrame:
    """The grid of one of the ``STUDIES``."""
    s = STUDIES[name]
    orders = s.get("orders") or [root_order(c) for c in s["clusters"]]
    return experiment_grid(objects, orders, s["depth"], s["iters"], trials, s["methods"])


def grid_table(grid: DataFrame) -> DataFrame:
    return results_table(grid, "param", "trial", ["clusters", "rmse", "seconds"])


def root_order(clusters: int) -> int:
    """The order of a tree of two levels of keys for about so many clusters."""
    return max(2, round(math.sqrt(clusters)))


def title_job(spark: SparkSession, path: str) -> DataFrame:
    """(trec_id, title) of the pages in the archives at ``path``."""
    return extract_titles(read_warc(spark, path))

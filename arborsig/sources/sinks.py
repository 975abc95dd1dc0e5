"""Sinks for cluster assignments and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_visits(visits: DataFrame, prefix: str) -> None:
    """A folder for each level of comma-separated rows: object id, cluster id, distance to the cluster's key."""
    visits.select("level", F.col("id").alias("object ID"), F.col("node_id").alias("cluster ID"), F.col("dist").alias("distance to cluster center")).write.mode("overwrite").partitionBy("level").option("header", True).csv(f"{prefix}_clusters")


def write_stats(stats: DataFrame, prefix: str) -> None:
    """A folder for each level of comma-separated rows: parent, cluster, RMSE, object count."""
    named = stats.select("level", F.col("parent_id").alias("parent cluster ID"), F.col("node_id").alias("cluster ID"), F.col("rmse").alias("RMSE"), F.col("object_count").alias("object count"))
    named.write.mode("overwrite").partitionBy("level").option("header", True).csv(f"{prefix}_stats")


def write_members(members: DataFrame, path: str) -> None:
    """Lines of ``id cluster``."""
    members.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("cluster").cast("string"))).write.mode("overwrite").text(path)


def write_titles(titles: DataFrame, path: str) -> None:
    """Pairs of lines: id, title."""
    titles.select(F.concat_ws("\n", "trec_id", "title")).write.mode("overwrite").text(path)


def results_table(results: DataFrame, parameter: str, trial: str, values: list[str]) -> DataFrame:
    """A row a parameter, with a group of columns for each of ``values`` by trial."""
    return results.groupBy(parameter).pivot(trial).agg(*[F.first(v).alias(v) for v in values])

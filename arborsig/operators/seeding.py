"""Choice of objects by a seeded order of hashes: reproducible, and the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distance import HAMMING, Distance
from ..session import durable


def order_hash(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


#: Up to so many rows a sample is taken by one ordered limit; larger ones are cut by the leading digits of the hashes.
FEW = 10_000


def sample(df: DataFrame, n: int, id: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, all rows if there are fewer: the first in order of their hashes.

    A large sample is never ordered in one task: rows are counted by the first four digits of their hashes (65,536
    counts at most), all rows of the digits before the n-th row's are kept, and only that one bucket is ordered.
    """
    if n <= FEW:
        return df.orderBy(order_hash(id, seed), id).limit(n)
    hashed = df.withColumn("_o", order_hash(id, seed)).withColumn("_h", F.substring("_o", 1, 4))
    before, last = 0, None
    for h, count in sorted((r["_h"], r["count"]) for r in hashed.groupBy("_h").count().collect() if r["_h"] is not None):
        if before + count >= n:
            last = h
            break
        before += count
    if last is None:
        return df
    rest = hashed.where(F.col("_h") == last).orderBy("_o", id).limit(n - before)
    return hashed.where(F.col("_h") < last).unionByName(rest).drop("_o", "_h")


def hash_sample(df: DataFrame, n: int, total: int, id: str = "id", salt: str = "") -> DataFrame:
    """About ``n`` to 1.3 ``n`` of ``df``'s ``total`` rows, chosen by a hash of their ids, without sorting any.

    For samples that are collected: each partition gives its share only, however many partitions there are.
    """
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(id), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.3 * n / total)))


def random_seeds(df: DataFrame, k: int, id: str = "id", seed: int = 42, by: str | None = None) -> DataFrame:
    """``df``'s first ``k`` rows in random order, of each group ``by`` if given, with ``idx`` counting from 0."""
    if by is None:
        # the rows are cut down before they are numbered, so that no task gets them all
        return sample(df, k, id, seed).withColumn("idx", F.row_number().over(Window.orderBy(order_hash(id, seed), id)) - 1)
    w = Window.partitionBy(by).orderBy(order_hash(id, seed), id)
    # the limit is on the number itself, so that each partition is cut down to k rows a group before the shuffle
    return df.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= k).withColumn("idx", F.col("idx") - 1)


def uniform(seed: int, step: int) -> float:
    """A number in [0, 1), the same for the same seed and step."""
    import hashlib

    return int(hashlib.md5(f"{seed}:u{step}".encode()).hexdigest()[:12], 16) / float(1 << 48)


#: Rows of a range of ids, of which one is ordered for each draw; ranges at most.
RANGE_ROWS, MOST_RANGES = 100_000, 4096


def in_ranges(df: DataFrame, id: str) -> DataFrame:
    """``df`` cut into ranges of ids, numbered in order by ``_p``; what the ids look like doesn't matter."""
    parts = max(1, min(MOST_RANGES, df.count() // RANGE_ROWS))
    return durable(df.repartitionByRange(parts, id).withColumn("_p", F.spark_partition_id()))


def pick_by_weight(df: DataFrame, u: float, id: str, weight: str) -> tuple:
    """(id, total): the first row in order of ``id`` at which the running sum of weights reaches u * total.

    Sums by range (see ``in_ranges``) say which one the row is in, and only that one is ordered.
    """
    if "_p" not in df.columns:
        df = in_ranges(df, id)
    sums = sorted((r["_p"], r["s"] or 0) for r in df.groupBy("_p").agg(F.sum(weight).alias("s")).collect())  # a row a range
    total = sum(s for _, s in sums)
    target, run, chosen = u * total, 0, sums[-1][0]
    for p, s in sums:
        if run + s >= target:
            chosen = p
            break
        run += s
    inside = df.where(F.col("_p") == chosen).withColumn("_c", F.lit(run) + F.sum(weight).over(Window.partitionBy("_p").orderBy(id).rowsBetween(Window.unboundedPreceding, 0)))
    row = inside.where(F.col("_c") >= target).orderBy(id).select(id).first()
    return (row[0] if row else df.agg(F.max(id)).first()[0]), total


def distance_seeds(df: DataFrame, k: int, id: str = "id", value: str = "sig", distance: Distance = HAMMING, seed: int = 42, tries: int = 1, draws: list[float] | None = None) -> list:
    """The ids of ``k`` objects, each after the first drawn in proportion to its distance from those chosen before.

    The first is the first in random order.  Of ``tries`` draws the one that leaves the least sum of distances counts.
    ``draws`` gives the random numbers.  A draw of 0 picks the first object, whatever its weight.
    """
    from .nearest import literal

    first = sample(df, 1, id, seed).select(id, value).first()
    if first is None:
        return []
    chosen = [first[0]]
    state = in_ranges(df.select(id, value, distance.column(F.col(value), literal(first[1], distance)).alias("_d")), id)
    step = 0
    while len(chosen) < k:
        best = None
        for _ in range(tries):
            u = draws[step] if draws else uniform(seed, step)
            step += 1
            pick, total = pick_by_weight(state, u, id, "_d")
            key = state.where(F.col(id) == pick).select(value).first()[0]
            nearer = F.least("_d", distance.column(F.col(value), literal(key, distance)))
            left = state.agg(F.sum(nearer)).first()[0] if tries > 1 else 0
            if best is None or left < best[0]:
                best = (left, pick, nearer)
        chosen.append(best[1])
        state = durable(state.withColumn("_d", best[2]))
    return chosen

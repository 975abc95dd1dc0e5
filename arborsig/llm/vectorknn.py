"""The k nearest vectors for every vector, by a permutation index.

1. Equal vectors are merged into a class that keeps its k + 1 smallest ids, which is all any answer can need of it.
2. Pivots are drawn from a bounded sample of the classes; those that would draw far more than their share of the sample
   are left out.  A vector's permutation is the list of its nearest pivots, nearest first.
3. Each class is posted, once for each of its first ``POSTS`` pivots, in that pivot's inverted file.  A query looks into
   the files of these same pivots, so each file answers its own members; a file that is too large is compared in pairs of
   blocks.
4. In a file the members are ranked by the footrule distance of their permutations from the query's, and the first of
   them, a fixed number or a share of the file if that is more, are reranked by their true distances.  Where these show
   no contrast, as in noise, the whole file is reranked.
5. Each query's answers from its files are merged.  On demand they are then proven and completed exactly.

There is one level of files, so that a vector is copied ``POSTS`` times however large the collection is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.seeding import hash_sample
from ..session import durable, spread

#: Vectors for each pivot, and the bounds of the number of pivots.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 8, 32_768
#: Candidates for each pivot, and how many rows of the sample they are tried on at most.
CANDIDATES, TRIED = 1.5, 8192
#: Pivots of a permutation, those of them a query counts the footrule over; files a vector is posted in.
LENGTH, ASKED, POSTS = 48, 32, 8
#: Members of a file that are reranked by their true distances: so many, and this share of the file.
RERANKED, RERANKED_SHARE = 200, 0.25
#: The whole file is reranked if the k-th distance is above this part of the median of those of the reranked.
CONTRAST = 0.7
#: Members of a block of a file.
FILE = 8192


def usable(df: DataFrame, dims: int, id: str = "id", v: str = "v") -> DataFrame:
    """(id, v): rows with an id and ``dims`` finite numbers, each id once (with the least vector if they differ)."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id).isNotNull() & (F.size(v) == dims) & finite).groupBy(F.col(id).alias("id")).agg(F.min(F.transform(v, lambda x: x.cast("float") + F.lit(0.0).cast("float"))).alias("v"))


def _rows(packed: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f4").reshape(-1, dims)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The indices of the m nearest pivots of each row of x, nearest first, the smaller index of equally near ones."""
    m = min(m, len(pivots))
    out = np.empty((len(x), m), np.int64)
    norm = (pivots**2).sum(1)[None, :]
    for s in range(0, len(x), 1024):
        d = norm - 2 * (x[s : s + 1024] @ pivots.T)
        top = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(len(pivots)), (len(d), 1))
        top.sort(axis=1)
        out[s : s + 1024] = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)
    return out


def choose_pivots(sample: np.ndarray, n: int, posts: int = POSTS, rounds: int = 3) -> np.ndarray:
    """``n`` of the sample's vectors, without those that are among the first pivots of most others, round by round."""
    keep = np.arange(len(sample))
    drop = max(0, len(sample) - n)
    tried = sample[: TRIED]
    for r in range(rounds):
        out = drop * (r + 1) // rounds - drop * r // rounds
        if out:
            posted = np.bincount(nearest_pivots(tried, sample[keep], posts).ravel(), minlength=len(keep))
            keep = np.delete(keep, np.argsort(-posted, kind="stable")[:out])
    return sample[keep]


def footrule(places: np.ndarray, permutation: np.ndarray) -> np.ndarray:
    """The footrule distance of each member from a query over the query's pivots.

    ``places`` has a row a pivot with its place in each member's permutation, or the permutations' length where it isn't
    in it; ``permutation`` has the row numbers of the query's pivots, nearest first, -1 for those no member has (which
    count the same for all members and are left out).
    """
    own = np.flatnonzero(permutation >= 0)
    p, rank = places[permutation[own]], own.astype(np.uint8)[:, None]
    high = np.maximum(p, rank)
    return np.subtract(high, np.minimum(p, rank, out=p), out=high).sum(0, dtype=np.uint16)


def search_file(m: pd.DataFrame, q: pd.DataFrame, dims: int, k: int, reranked: int = RERANKED, share: float = RERANKED_SHARE) -> list[list[tuple[float, str, int]]]:
    """For each query of ``q`` up to k of the nearest members of ``m`` as (squared distance, rep, cid), nearest first.

    Both have (cid, rep, vec, perm), ``m`` sorted by rep, by which ties are broken.
    """
    cid, rep, x = m["cid"].to_numpy(), m["rep"].to_numpy(), _rows(m["vec"], dims).astype(np.float64)
    y, mine = _rows(q["vec"], dims).astype(np.float64), q["cid"].to_numpy()
    middle = x.mean(0)
    x32, y32 = (x - middle).astype(np.float32), (y - middle).astype(np.float32)
    norm = (x32**2).sum(1)
    few = max(reranked, int(share * len(m)))
    if few < len(m):
        perm = np.frombuffer(b"".join(m["perm"]), dtype="<u2").reshape(len(m), -1)
        known, at = np.unique(perm, return_inverse=True)
        places = np.full((len(known), len(m)), perm.shape[1], np.uint8)
        places[at.reshape(perm.shape), np.arange(len(m))[:, None]] = np.arange(perm.shape[1], dtype=np.uint8)[None, :]
        asked = np.frombuffer(b"".join(q["perm"]), dtype="<u2").reshape(len(q), -1)[:, :ASKED]
        to = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        to[known[to] != asked] = -1
    every, n_best = np.arange(len(m)), 2 * k + 4
    out = []

    def nearest(i: int, others: np.ndarray) -> tuple[list, np.ndarray]:
        """The best of ``others``: taken in single precision with some to spare, then by their exact distances."""
        rough = norm[others] - 2 * (x32[others] @ y32[i])
        rough[cid[others] == mine[i]] = np.inf
        near = others[np.argpartition(rough, n_best)[:n_best]] if len(others) > n_best else others
        near = np.sort(near[cid[near] != mine[i]])
        d = ((x[near] - y[i]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")[:k]
        return [(float(d[b]), rep[near[b]], int(cid[near[b]])) for b in order], rough

    for i in range(len(q)):
        if few >= len(m):
            out.append(nearest(i, every)[0])
            continue
        best, rough = nearest(i, np.argpartition(footrule(places, to[i]), few)[:few])
        middling = np.partition(rough, few // 2)[few // 2] + (y32[i] ** 2).sum()
        if best and best[-1][0] > CONTRAST**2 * middling:
            best = nearest(i, every)[0]
        out.append(best)
    return out


def _sample(df: DataFrame, n: int, total: int, salt: str) -> np.ndarray:
    """The vectors of at most ``n`` classes, the same for the same classes."""
    rows = sorted(hash_sample(df.select("vec", "cid"), n, total, "cid", salt).collect(), key=lambda r: r["cid"])[:n] or df.select("vec").limit(n).collect()
    x = np.stack([np.frombuffer(r["vec"], dtype="<f4") for r in rows])
    return x[np.random.default_rng(7).permutation(len(x))]


def index_classes(classes: DataFrame, dims: int, n: int) -> DataFrame:
    """(cid, rep, vec, perm, files): each class with its permutation and the files it is posted in.

    What is collected and broadcast are pivots and candidates for them, at most ``CANDIDATES`` x ``MOST_PIVOTS``.
    """
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, n // PER_PIVOT))
    shared = classes.sparkSession.sparkContext.broadcast(choose_pivots(_sample(classes, int(CANDIDATES * wanted), n, "pivot"), wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            near = nearest_pivots(_rows(p["vec"], dims), shared.value, LENGTH).astype("<u2")
            yield p.assign(perm=[r.tobytes() for r in near], files=[r[:POSTS].tolist() for r in near])

    return spread(classes.select("cid", F.col("ids")[0].alias("rep"), "vec")).mapInPandas(run, "cid bigint, rep string, vec binary, perm binary, files array<int>")


def blocks_of(posted: DataFrame, file_rows: int = FILE) -> DataFrame:
    """``posted`` (file, role, ...) with (ask, hold): what each pair of blocks of each file gets.

    Role 1 asks, 2 is held, 3 both.  No pair of blocks has many more than 2 x ``file_rows`` rows.
    """
    sizes = posted.groupBy("file").count().where(F.col("count") > file_rows)
    large = sizes.select("file", F.ceil(F.col("count") / file_rows).cast("int").alias("blocks"))
    cut = posted.join(F.broadcast(large), "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # at most a row a pivot
    cut = cut.withColumn("at", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    step = lambda ask, hold, role: F.struct(F.col(ask).alias("ask"), F.col(hold).alias("hold"), role.alias("role"))
    once = F.array(step("at", "at", F.col("role")))
    asks, held = F.array(step("at", "by", F.lit(1))), F.array(step("by", "at", F.lit(2)))
    roles = F.when(F.col("at") == F.col("by"), once).when(F.col("role") == 1, asks).when(F.col("role") == 2, held).otherwise(F.concat(asks, held))
    return cut.withColumn("roles", roles).drop("role", "at", "by", "blocks").select("*", F.inline("roles")).drop("roles")


_BEST = "array<struct<dist:double,rep:string,other:bigint>>"


def _searched(posted: DataFrame, dims: int, k: int, file_rows: int, share: float) -> DataFrame:
    """(cid, best): what each file of ``posted`` (file, role, cid, rep, vec, perm) answers to the queries in it."""

    def answer(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rep", kind="stable")
        m, q = p[p["role"] != 1], p[p["role"] != 2]
        found = search_file(m, q, dims, k, share=share) if len(m) and len(q) else [[] for _ in range(len(q))]
        return pd.DataFrame({"cid": q["cid"].to_numpy(), "best": pd.Series([[{"dist": d, "rep": r, "other": o} for d, r, o in b] for b in found], dtype=object)})

    return blocks_of(posted, file_rows).groupBy("file", "ask", "hold").applyInPandas(answer, f"cid bigint, best {_BEST}")


def _merged(answers: DataFrame, k: int) -> DataFrame:
    return answers.groupBy("cid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))


def _prove(indexed: DataFrame, near: DataFrame, dims: int, k: int, file_rows: int) -> DataFrame:
    """``near`` made exact: each query is compared with all members of every first pivot's cell that reaches within its
    k-th distance.  In regions that differ by noise these are all cells, which is quadratic in the size of the region."""

    def ball(p: pd.DataFrame) -> pd.DataFrame:
        x = _rows(p["vec"], dims).astype(np.float64)
        c = x[0] if len(x) < 2 else x.mean(0)
        return pd.DataFrame({"file": [p["file"].iloc[0]], "centre": [c.tobytes()], "radius": [float(np.sqrt(((x - c) ** 2).sum(1).max()))]})

    cells = indexed.withColumn("file", F.col("files")[0]).drop("files")
    salted = cells.withColumn("_s", F.pmod(F.xxhash64("cid"), F.lit(16)))  # a large cell is several balls
    balls = salted.groupBy("file", "_s").applyInPandas(ball, "file int, centre binary, radius double").collect()  # at most 16 a pivot
    shared = indexed.sparkSession.sparkContext.broadcast((np.array([r["file"] for r in balls]), np.stack([np.frombuffer(r["centre"]) for r in balls]), np.array([r["radius"] for r in balls])))
    bounded = cells.drop("file").join(near.select("cid", F.try_element_at("best", F.lit(k))["dist"].alias("bound")), "cid", "left")

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, centres, radii = shared.value
        norm = (centres**2).sum(1)[None, :]
        for p in batches:
            for s in range(0, len(p), 512):
                part = p.iloc[s : s + 512]
                x = _rows(part["vec"], dims).astype(np.float64)
                bound = np.sqrt(part["bound"].astype(float).fillna(np.inf).to_numpy())
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + norm - 2 * (x @ centres.T), 0))
                i, j = np.nonzero(d - radii[None, :] <= bound[:, None] + 1e-6 * (1 + d + radii[None, :]))
                pairs = np.unique(np.stack([i, file[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
                yield part.iloc[pairs[:, 0]][["cid", "rep", "vec", "perm"]].assign(file=pairs[:, 1].astype(np.int32), role=np.int32(1))

    asks = durable(bounded.select("cid", "rep", "vec", "perm", "bound").mapInPandas(reaching, "cid bigint, rep string, vec binary, perm binary, file int, role int"))
    more = _searched(asks.unionByName(cells.withColumn("role", F.lit(2))), dims, k, file_rows, 1.0)
    return _merged(near.union(more), k)


def nearest_classes(classes: DataFrame, dims: int, k: int, n: int, file_rows: int = FILE, exact: bool = False) -> DataFrame:
    """(cid, best): up to k of the nearest other classes of each class (cid, vec, ids) as an array of (dist, rep, other)."""
    indexed = durable(index_classes(classes, dims, n))
    posted = indexed.withColumn("file", F.explode("files")).drop("files").withColumn("role", F.lit(3))
    near = _merged(_searched(posted, dims, k, file_rows, RERANKED_SHARE), k)
    return _prove(indexed, durable(near), dims, k, file_rows) if exact else near


def nearest_vectors(df: DataFrame, k: int = 10, dims: int = 64, id: str = "id", v: str = "v", file_rows: int = FILE, exact: bool = False) -> DataFrame:
    """(id, other, dist, rank): the k nearest other ids of every usable vector by Euclidean distance, with little loss.

    Equal distances go to the smaller id.  Rows without an id, with a null, short or empty vector or with numbers that
    aren't finite don't take part; repeated rows count once; other columns are ignored.  With fewer than k others, all
    are returned; an empty input gives an empty result.  With ``exact`` the index's answers are proven and completed,
    at a cost that is quadratic in the size of regions of mere noise.
    """
    ids = usable(df, dims, id, v)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "vec": [np.asarray(a, dtype="<f4").tobytes() for a in p["v"]]})

    tagged = durable(ids.mapInPandas(packed, "id string, vec binary").withColumn("cid", F.xxhash64("vec")))
    # the smallest ids of a class, pre-aggregated by salted parts, as a class may hold a large share of all rows
    salted = tagged.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("cid", "_s").orderBy("id"))).where(F.col("_r") <= k + 1)
    classes = durable(salted.groupBy("cid", "vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))
    n = classes.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "id string, other string, dist double, rank int")
    near = nearest_classes(classes, dims, k, n, file_rows, exact).select("cid", F.inline("best")).select("cid", "other", "dist").union(classes.select("cid", "cid", F.lit(0.0)))
    named = near.join(classes.select(F.col("cid").alias("other"), "ids"), "other").select("cid", "dist", F.explode("ids").alias("id"))
    lists = named.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "id"))), 1, k + 1).alias("best"))
    mine = tagged.select("cid", F.col("id").alias("me")).join(lists, "cid").select("me", F.slice(F.filter("best", lambda x: x["id"] != F.col("me")), 1, k).alias("best"))
    out = mine.select(F.col("me").alias("id"), F.posexplode("best").alias("_p", "_b"))
    return out.select("id", F.col("_b.id").alias("other"), F.sqrt("_b.dist").alias("dist"), (F.col("_p") + 1).alias("rank"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of which one is among the nearest of the other."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

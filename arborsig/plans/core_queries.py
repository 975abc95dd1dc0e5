"""Queries of the core package for the driver's contract, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import bits, vectors
from ..functions.distance import EUCLIDEAN, EUCLIDEAN_SQ, HAMMING
from ..operators.badrows import find_errors, load_rows
from ..operators.kmeans import KMeans, rmse
from ..operators.ktree import ktree
from ..operators.nearest import distances, nearest, sum_squared_error
from ..operators.prototype import prototypes
from ..operators.seeding import distance_seeds, random_seeds, sample
from ..operators.select import balanced_dims, dim_histogram, error_to_mean_and_first, reduce_dims, subset
from ..operators.tree import descend_joined, leaf_counter, level_counts, level_stats, size_histogram, tree_stats
from ..operators.treebuild import EMTree, tsvq, with_distances
from ..session import shared_dir, table
from ..sources.signatures import random_signatures, random_vectors
from ..sources.warc import field, has_field, title, write_warc
from ..streaming.streaming_emtree import StreamingEMTree, insert_prune_report, insert_write_clusters, run_batches, run_passes
from . import jobs
from .core_sql import ORDER, SIGS, assign, bit, descend, hamming, kmeans, majority, pack, pruned, query, rebuilt, rolled, split, up

QUERIES: dict = {}
SQL: dict[str, str] = {}
M, DEPTH = 4, 3  # the order and depth of the trees of the queries: two levels of keys
K = 10


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def sigs(spark, d) -> DataFrame:
    """One 64-bit signature a vector: the signs of its numbers."""
    return embeddings(spark, d).select("id", "label", bits.sign_bits(F.col("v"), 64).alias("sig"))


def keys_of(df: DataFrame, k: int, value: str) -> list:
    """The values of the first ``k`` rows in random order: a model of fixed size."""
    return [r[value] for r in random_seeds(df, k).orderBy("idx").select(value).collect()]


# bits

@register(f"WITH {SIGS} SELECT id, sig AS word FROM sigs")
def sig_pack(spark, d):
    return sigs(spark, d).select("id", F.col("sig")[0].alias("word"))


@register(f"WITH {SIGS} SELECT id, CAST(i AS INTEGER) AS dim, CAST((sig >> i) & 1 AS INTEGER) AS bit FROM sigs, range(64) t(i)")
def sig_unpack(spark, d):
    return sigs(spark, d).select("id", F.posexplode(bits.unpack(F.col("sig"))).alias("dim", "bit"))


@register(f"WITH {SIGS} SELECT id, CAST(bit_count(sig) AS BIGINT) AS ones FROM sigs")
def sig_popcount(spark, d):
    return sigs(spark, d).select("id", bits.popcount(F.col("sig")).alias("ones"))


@register(f"WITH {SIGS} SELECT id, ~sig AS word FROM sigs")
def sig_invert(spark, d):
    return sigs(spark, d).select("id", bits.invert(F.col("sig"))[0].alias("word"))


@register(f"WITH {SIGS}, f AS (SELECT sig FROM sigs ORDER BY {ORDER} LIMIT 1) SELECT s.id, xor(s.sig, f.sig) AS word FROM sigs s, f")
def sig_xor_first(spark, d):
    from ..operators.nearest import literal

    s = sigs(spark, d)
    return s.select("id", bits.xor(F.col("sig"), literal(keys_of(s, 1, "sig")[0], HAMMING))[0].alias("word"))


_FORMAT = " || ' ' || ".join(" || ".join(f"CAST({bit(i)} AS VARCHAR)" for i in range(h, h - 16, -1)) for h in (63, 47, 31, 15))


@register(f"WITH {SIGS} SELECT id, {_FORMAT} AS shown FROM sigs")
def sig_format(spark, d):
    return sigs(spark, d).select("id", bits.show(F.col("sig")).alias("shown"))


@register(f"WITH {SIGS} SELECT id, CAST({bit(5)} AS INTEGER) AS bit5, sig | 1024 AS with10, sig | 255 AS with_block FROM sigs")
def sig_set_get(spark, d):
    s = F.col("sig")
    return sigs(spark, d).select("id", bits.get_bit(s, 5).alias("bit5"), bits.set_bit(s, 10)[0].alias("with10"), bits.or_word(s, 0, F.lit(255).cast("bigint"))[0].alias("with_block"))


# dense vectors

_VEC = "SELECT vec_id AS id, CAST(i AS INTEGER) AS dim, round({}, 6) AS x FROM embeddings, range(64) t(i)"
_V = "CAST(embedding[i + 1] AS DOUBLE)"


def _vec(spark, d, f):
    return embeddings(spark, d).select("id", F.posexplode(f(F.col("v"))).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


@register(_VEC.format(f"{_V} + {_V}"))
def vec_add(spark, d):
    return _vec(spark, d, lambda v: vectors.add(v, v))


@register(_VEC.format(f"{_V} + {_V} * -0.5"))
def vec_addmult(spark, d):
    return _vec(spark, d, lambda v: vectors.add_mult(v, v, -0.5))


@register(_VEC.format(f"{_V} * 3"))
def vec_scale(spark, d):
    return _vec(spark, d, lambda v: vectors.scale(v, 3.0))


# distances

_FIRST = f"WITH {SIGS}, f AS (SELECT row_number() OVER (ORDER BY {ORDER}) - 1 AS idx, id, sig FROM sigs), k AS (SELECT idx, id AS kid, sig AS ksig FROM f WHERE idx < 8)"
_EUCLID = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2))"


@register(f"{_FIRST} SELECT s.id, CAST(k.idx AS INTEGER) AS idx, {hamming('s.sig', 'k.ksig')} AS dist FROM sigs s, k")
def hamming_pairs(spark, d):
    s = sigs(spark, d)
    return distances(s, keys_of(s, 8, "sig")).select("id", "idx", "dist")


@register(f"{_FIRST} SELECT s.id, CAST(k.idx AS INTEGER) AS idx, {hamming('s.sig', 'k.ksig')} * {hamming('s.sig', 'k.ksig')} AS dist FROM sigs s, k")
def hamming_sq_pairs(spark, d):
    s = sigs(spark, d)
    return distances(s, keys_of(s, 8, "sig"), squared=True).select("id", "idx", "dist")


def _euclid(spark, d, distance):
    e = embeddings(spark, d)
    return distances(e, keys_of(e, 8, "v"), "v", distance).select("id", "idx", F.round("dist", 5).alias("dist"))


@register(f"{_FIRST} SELECT a.vec_id AS id, CAST(k.idx AS INTEGER) AS idx, round({_EUCLID}, 5) AS dist FROM embeddings a, k JOIN embeddings b ON b.vec_id = k.kid")
def euclid_sq_pairs(spark, d):
    return _euclid(spark, d, EUCLIDEAN_SQ)


@register(f"{_FIRST} SELECT a.vec_id AS id, CAST(k.idx AS INTEGER) AS idx, round(sqrt({_EUCLID}), 5) AS dist FROM embeddings a, k JOIN embeddings b ON b.vec_id = k.kid")
def euclid_pairs(spark, d):
    return _euclid(spark, d, EUCLIDEAN)


# nearest

def _near_sql(agg: str, sign: str, s: str, k: str) -> str:
    packed = f"{agg}({hamming(s, k)} * 4294967296 {sign})"
    return f"{_FIRST}, p AS (SELECT s.id, {packed} AS packed FROM sigs s, k GROUP BY s.id)"


@register(_near_sql("min", "+ k.idx", "s.sig", "k.ksig") + " SELECT id, CAST(packed % 4294967296 AS INTEGER) AS idx, packed // 4294967296 AS dist FROM p")
def nearest_min(spark, d):
    s = sigs(spark, d)
    return nearest(s, keys_of(s, 8, "sig")).select("id", "idx", "dist")


@register(_near_sql("max", "+ (4294967295 - k.idx)", "s.sig", "k.ksig") + " SELECT id, CAST(4294967295 - packed % 4294967296 AS INTEGER) AS idx, packed // 4294967296 AS dist FROM p")
def nearest_max(spark, d):
    s = sigs(spark, d)
    return nearest(s, keys_of(s, 8, "sig"), greatest=True, strategy="arrow").select("id", "idx", "dist")


@register(_near_sql("min", "+ k.idx", "(s.sig & 255)", "(k.ksig & 255)") + " SELECT id, CAST(packed % 4294967296 AS INTEGER) AS idx, packed // 4294967296 AS dist FROM p")
def nearest_ties(spark, d):
    s = sigs(spark, d).withColumn("sig", F.transform("sig", lambda w: w.bitwiseAND(F.lit(255).cast("bigint"))))
    return nearest(s, keys_of(s, 8, "sig")).select("id", "idx", "dist")


@register(f"WITH {SIGS}, p AS (SELECT label, {majority()} AS key FROM sigs GROUP BY label), e AS (SELECT s.label, {hamming('s.sig', 'p.key')} AS d FROM sigs s JOIN p ON s.label = p.label) SELECT label, count(*) AS count, CAST(sum(d * d) AS BIGINT) AS sse, round(sqrt(sum(d * d) / count(*)), 6) AS rmse FROM e GROUP BY label")
def sse_rmse_by_label(spark, d):
    s = sigs(spark, d)
    keys = prototypes(s, "label").select("label", "key")
    at = s.join(keys, "label").select("label", HAMMING.column(F.col("sig"), F.col("key")).alias("dist"))
    return sum_squared_error(at, ["label"]).select("label", "count", "sse", F.round("rmse", 6).alias("rmse"))


# prototypes

@register(f"WITH {SIGS} SELECT count(*) AS count, {majority()} AS word FROM sigs")
def majority_global(spark, d):
    return prototypes(sigs(spark, d).withColumn("g", F.lit(0)), "g").select("count", F.col("key")[0].alias("word"))


@register(f"WITH {SIGS} SELECT label, count(*) AS count, {majority()} AS word FROM sigs GROUP BY label")
def majority_by_label(spark, d):
    return prototypes(sigs(spark, d), "label").select("label", "count", F.col("key")[0].alias("word"))


@register(f"WITH {SIGS} SELECT label, {majority(w='(1 + id % 5)')} AS word FROM sigs GROUP BY label")
def majority_weighted(spark, d):
    s = sigs(spark, d).withColumn("w", 1 + F.col("id") % 5)
    return prototypes(s, "label", weight="w").select("label", F.col("key")[0].alias("word"))


_MEAN = "SELECT label, CAST(i AS INTEGER) AS dim, round(sum(CAST(embedding[i + 1] AS DOUBLE) * {w}) / sum({w}), 5) AS x FROM embeddings, range(64) t(i) GROUP BY label, i"


@register(_MEAN.format(w="1"))
def mean_by_label(spark, d):
    return prototypes(embeddings(spark, d), "label", "v", bits=False).select("label", F.posexplode("key").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("x"))


@register(_MEAN.format(w="(1 + vec_id % 5)"))
def mean_weighted(spark, d):
    e = embeddings(spark, d).withColumn("w", 1 + F.col("id") % 5)
    return prototypes(e, "label", "v", "w", bits=False).select("label", F.posexplode("key").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("x"))


@register(f"WITH {SIGS}, m AS (SELECT {majority()} AS key FROM sigs), f AS (SELECT sig AS first FROM sigs ORDER BY id LIMIT 1) SELECT round(avg({hamming('sig', 'key')}), 6) AS mean_error, round(avg({hamming('sig', 'first')}), 6) AS first_error FROM sigs, m, f")
def mean_vs_first_error(spark, d):
    return error_to_mean_and_first(sigs(spark, d)).select(F.round("mean_error", 6).alias("mean_error"), F.round("first_error", 6).alias("first_error"))


# seeds

@register(f"WITH {SIGS} SELECT id, CAST(row_number() OVER (ORDER BY {ORDER}) - 1 AS INTEGER) AS idx FROM sigs QUALIFY idx < {K}")
def seed_random(spark, d):
    return random_seeds(sigs(spark, d), K).select("id", "idx")


@register(f"WITH {SIGS} SELECT id FROM sigs ORDER BY {ORDER} LIMIT 50")
def sample_n(spark, d):
    return sample(sigs(spark, d), 50).select("id")


_DRAWS = [0.5, 0.25, 0.75]


def _distance_seed_sql() -> str:
    ctes = [SIGS, f"c0 AS (SELECT id, sig FROM sigs ORDER BY {ORDER} LIMIT 1)", f"d0 AS (SELECT s.id, s.sig, {hamming('s.sig', 'c0.sig')} AS d FROM sigs s, c0)"]
    for i, u in enumerate(_DRAWS, 1):
        ctes += [f"w{i} AS (SELECT id, sig, sum(d) OVER (ORDER BY id) AS c, sum(d) OVER () AS t FROM d{i - 1})", f"c{i} AS (SELECT id, sig FROM w{i} WHERE c >= {u} * t ORDER BY id LIMIT 1)", f"d{i} AS (SELECT s.id, s.sig, least(s.d, {hamming('s.sig', f'c{i}.sig')}) AS d FROM d{i - 1} s, c{i})"]
    return query(ctes, " UNION ALL ".join(f"SELECT {i} AS idx, id FROM c{i}" for i in range(len(_DRAWS) + 1)))


@register(_distance_seed_sql())
def seed_dsq(spark, d):
    ids = distance_seeds(sigs(spark, d), len(_DRAWS) + 1, draws=_DRAWS)
    return spark.createDataFrame(list(enumerate(ids)), "idx int, id bigint")


# k-means

_OBJ = "o AS (SELECT id, sig, '' AS g FROM sigs)"


def _kmeans(spark, d, iters):
    return KMeans(K, iters).cluster(sigs(spark, d))


def _kmeans_rows(found) -> DataFrame:
    return found.assigned.select("id", "idx", "dist")


@register(query([SIGS, _OBJ, *kmeans("k", "o", K, 0)], "SELECT id, CAST(idx AS INTEGER) AS idx, dist FROM k_a"))
def kmeans_assign(spark, d):
    return _kmeans_rows(_kmeans(spark, d, 0))


@register(query([SIGS, _OBJ, *kmeans("k", "o", K, 1)], "SELECT CAST(idx AS INTEGER) AS idx, sig AS word FROM k_k"))
def kmeans_one_iter(spark, d):
    found = _kmeans(spark, d, 1)
    return spark.createDataFrame([(i, v[0]) for i, v in found.keys[""].items()], "idx int, word bigint")


@register(query([SIGS, _OBJ, *kmeans("k", "o", K, 3)], "SELECT id, CAST(idx AS INTEGER) AS idx, dist FROM k_a"))
def kmeans_three_iters(spark, d):
    return _kmeans_rows(_kmeans(spark, d, 3))


@register(query([SIGS, _OBJ, *kmeans("k", "o", K, 3)], f"SELECT round(sqrt(sum({hamming('a.sig', 'k.sig')} * {hamming('a.sig', 'k.sig')}) / count(*)), 6) AS rmse FROM k_a a JOIN k_k k ON a.g = k.g AND a.idx = k.idx"))
def kmeans_rmse(spark, d):
    return spark.createDataFrame([(round(rmse(_kmeans(spark, d, 3)), 6),)], "rmse double")


@register(query([SIGS, _OBJ, *kmeans("k", "o", K, 3)], "SELECT id, CAST(dense_rank() OVER (ORDER BY idx) - 1 AS INTEGER) AS cluster FROM k_a"))
def kmeans_clusters_dense(spark, d):
    return _kmeans(spark, d, 3).members()


# trees

_TSVQ = [SIGS, *split("t", "sigs", [M, M], 2)]
_SEED0 = [SIGS, *split("t", "sigs", [M, M], 0)]
_NODES = "SELECT node_id, parent_id, CAST(level AS INTEGER) AS level, CAST(idx AS INTEGER) AS idx, sig AS word FROM {}"


def _tree(spark, d, iters=2):
    return tsvq(sigs(spark, d), M, DEPTH, iters)


def _words(tree, spark) -> DataFrame:
    return tree.frame(spark).select("node_id", "parent_id", "level", "idx", F.col("key")[0].alias("word"))


@register(query(_TSVQ, "SELECT id, leaf_id FROM t_leaf"))
def tsvq_assign(spark, d):
    return _tree(spark, d)[1].select("id", "leaf_id")


@register(query(_TSVQ, _NODES.format("t_nodes")))
def tsvq_nodes(spark, d):
    return _words(_tree(spark, d)[0], spark)


_STATS = f"SELECT count(*) AS objects, count(DISTINCT l.leaf_id) AS clusters, 2 AS levels, 2 AS min_level, round(sqrt(sum({hamming('l.sig', 'n.sig')} * {hamming('l.sig', 'n.sig')}) / count(*)), 6) AS rmse FROM {{leaf}} l JOIN {{nodes}} n ON l.leaf_id = n.node_id"


def _stats(tree, assigned) -> DataFrame:
    return tree_stats(tree, with_distances(tree, assigned)).withColumn("rmse", F.round("rmse", 6))


@register(query(_TSVQ, _STATS.format(leaf="t_leaf", nodes="t_nodes")))
def tsvq_stats(spark, d):
    return _stats(*_tree(spark, d))


@register(query([SIGS, *split("t", "sigs", [M, M], 1)], _NODES.format("t_nodes")))
def emtree_seed(spark, d):
    return _words(EMTree.seed(sigs(spark, d), [M, M]).tree, spark)


_STEP = [*_SEED0, *descend("e", "sigs", "t_nodes", 2), *pruned("p", "e_leaf", "t_nodes", 2), *rebuilt("b", "e_leaf", "p_nodes", 2)]


def _step(spark, d) -> EMTree:
    return EMTree.seed(sigs(spark, d), [M, M], update_means=False).em_step()


@register(query(_STEP, _NODES.format("b_nodes")))
def emtree_step(spark, d):
    return _words(_step(spark, d).tree, spark)


@register(query(_STEP, _STATS.format(leaf="e_leaf", nodes="b_nodes")))
def emtree_stats(spark, d):
    t = _step(spark, d)
    return _stats(t.tree, t.assigned)


_HALF = "half AS (SELECT * FROM sigs WHERE label < 5)"


@register(query([*_SEED0, _HALF, *descend("e", "half", "t_nodes", 2), *pruned("p", "e_leaf", "t_nodes", 2)], "SELECT id, leaf_id FROM e_leaf UNION ALL SELECT -1 - count(*), 'keys' FROM p_nodes"))
def emtree_replace(spark, d):
    s = sigs(spark, d)
    t, _ = EMTree.seed(s, [M, M], update_means=False).replace(s.where("label < 5")).prune()
    return t.assigned.select("id", "leaf_id").union(spark.createDataFrame([(-1 - len(t.tree.keys), "keys")], "id bigint, leaf_id string"))


_MOVED = [*_TSVQ, "top AS (SELECT 'r' AS g, idx, sig FROM t_nodes WHERE level = 1)", "low AS (SELECT node_id AS id, sig, 'r' AS g FROM t_nodes WHERE level = 2)", *assign("mv", "low", "top")]


@register(query([*_MOVED, "nm AS (SELECT id AS old, 'r.' || idx || '.' || (row_number() OVER (PARTITION BY idx ORDER BY CAST(split_part(id, '.', 2) AS INTEGER), CAST(split_part(id, '.', 3) AS INTEGER)) - 1) AS new FROM mv)"], "SELECT l.id, nm.new AS leaf_id FROM t_leaf l JOIN nm ON l.leaf_id = nm.old"))
def emtree_rearrange_internal(spark, d):
    return EMTree(*_tree(spark, d)).rearrange_internal().assigned.select("id", "leaf_id")


# the streaming tree: a seed tree from a sample, two passes of insert, prune and update

_SAMPLE = f"picked AS (SELECT * FROM sigs ORDER BY {ORDER} LIMIT 100)"
_S0 = [SIGS, _SAMPLE, *split("t", "picked", [M, M], 0)]
_S1 = [*_S0, *descend("i1", "sigs", "t_nodes", 2), *pruned("q1", "i1_leaf", "t_nodes", 2), *rolled("u1", "i1_leaf", "q1_nodes", 2)]
_S2 = [*_S1, *descend("i2", "sigs", "u1_nodes", 2), *pruned("q2", "i2_leaf", "u1_nodes", 2), *rolled("u2", "i2_leaf", "q2_nodes", 2)]
_S3 = [*_S2, *descend("v", "sigs", "u2_nodes", 2), *pruned("w", "v_leaf", "u2_nodes", 2)]


def _stream(spark, d, passes=0) -> tuple[StreamingEMTree, DataFrame]:
    s = sigs(spark, d)
    stream = jobs.seed_stream(sample(s, 100), None, M, DEPTH)
    run_passes(stream, s, passes)
    return stream, s


@register(query([*_S0, *descend("i1", "sigs", "t_nodes", 2)], "SELECT leaf_id, count(*) AS count, CAST(sum(dist * dist) AS BIGINT) AS sse FROM i1_leaf GROUP BY leaf_id"))
def stream_insert_stats(spark, d):
    stream, s = _stream(spark, d)
    stream.insert(s)
    return spark.createDataFrame([(leaf, a.count, int(a.sse)) for leaf, a in stream.acc.items()], "leaf_id string, count bigint, sse bigint")


@register(query([*_S0, *descend("i1", "sigs", "t_nodes", 2)], "SELECT leaf_id, CAST(i AS INTEGER) AS dim, CAST(sum((sig >> i) & 1) AS BIGINT) AS ones FROM i1_leaf, range(64) t(i) GROUP BY leaf_id, i"))
def stream_accumulators(spark, d):
    stream, s = _stream(spark, d)
    stream.insert(s)
    return stream.accumulators(spark)


@register(query(_S1, _NODES.format("u1_nodes")))
def stream_update_nodes(spark, d):
    return _words(_stream(spark, d, 1)[0].tree, spark)


@register(query(_S1, _NODES.format("q1_nodes")))
def stream_prune(spark, d):
    stream, s = _stream(spark, d)
    stream.insert(s)
    stream.prune()
    return _words(stream.tree, spark)


@register(query(_S3, "SELECT CAST(level AS INTEGER) AS level, id, node_id, dist FROM v_path"))
def stream_cluster_writer(spark, d):
    stream, s = _stream(spark, d, 2)
    return insert_write_clusters(stream, s)[0]


_LEVELS = " UNION ALL ".join(f"SELECT {up('leaf_id', n, 2)} AS node_id, dist FROM v_leaf" for n in (1, 2))


@register(query(_S3, f"SELECT CAST(n.level AS INTEGER) AS level, n.parent_id, n.node_id, round(sqrt(sum(e.dist * e.dist) / count(*)), 6) AS rmse, count(*) AS object_count FROM w_nodes n JOIN ({_LEVELS}) e ON n.node_id = e.node_id GROUP BY n.level, n.parent_id, n.node_id"))
def stream_cluster_stats(spark, d):
    stream, s = _stream(spark, d, 2)
    return insert_write_clusters(stream, s)[1].withColumn("rmse", F.round("rmse", 6))


@register(query(_S1, "SELECT CAST(l.level AS INTEGER) AS level, CAST(l.n AS INTEGER) AS clusters, s.objects, s.rmse FROM (SELECT level, count(*) AS n FROM q1_nodes GROUP BY level) l, (SELECT count(*) AS objects, round(sqrt(sum(dist * dist) / count(*)), 6) AS rmse FROM i1_leaf) s"))
def stream_report(spark, d):
    stream, s = _stream(spark, d)
    return insert_prune_report(stream, s).select("level", "clusters", "objects", F.round("rmse", 6).alias("rmse"))


_B = 250


def _batches_sql(n: int) -> list[str]:
    """Batches of _B rows in order of id, keys from all accumulated so far; batches past the last row are empty."""
    ctes = [*_S0, f"num AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // {_B} AS b FROM sigs)"]
    nodes, held = "t_nodes", []
    for i in range(n):
        ctes += [f"b{i} AS (SELECT * FROM num WHERE b = {i})", *descend(f"m{i}", f"b{i}", nodes, 2)]
        held.append(f"SELECT id, sig, leaf_id FROM m{i}_leaf")
        ctes += [f"h{i} AS ({' UNION ALL '.join(held)})", *rolled(f"r{i}", f"h{i}", nodes, 2)]
        nodes = f"r{i}_nodes"
    return ctes


@register(query(_batches_sql(8), _NODES.format("r7_nodes")))
def minibatch_nodes(spark, d):
    stream, s = _stream(spark, d)
    run_batches(stream, s, _B)
    return _words(stream.tree, spark)


_HYBRID = [SIGS, _SAMPLE, *split("t", "picked", [M, M], 2), *descend("e", "sigs", "t_nodes", 2), *pruned("p", "e_leaf", "t_nodes", 2), *rebuilt("b", "e_leaf", "p_nodes", 2), *descend("f", "sigs", "b_nodes", 2), *pruned("q", "f_leaf", "b_nodes", 2), *rebuilt("c", "f_leaf", "q_nodes", 2)]


@register(query(_HYBRID, _NODES.format("c_nodes")))
def hybrid_sample_seed(spark, d):
    return _words(jobs.hybrid_job(sigs(spark, d), 100, M, DEPTH).tree, spark)


@register(query([*_S0, *descend("i1", "sigs", "t_nodes", 2)], "SELECT id, leaf_id, dist FROM i1_leaf"))
def descend_by_join(spark, d):
    stream, s = _stream(spark, d)
    return descend_joined(stream.tree.frame(spark), s, 2)


@register(query([*_S0, *descend("i1", "sigs", "t_nodes", 2)], f"SELECT CAST(n.level AS INTEGER) AS level, n.parent_id, n.node_id, CASE WHEN count(e.dist) > 0 THEN round(sqrt(sum(e.dist * e.dist) / count(e.dist)), 6) ELSE CAST('nan' AS DOUBLE) END AS rmse, count(e.dist) AS object_count FROM t_nodes n LEFT JOIN ({_LEVELS.replace('v_leaf', 'i1_leaf')}) e ON n.node_id = e.node_id GROUP BY n.level, n.parent_id, n.node_id"))
def tree_level_stats(spark, d):
    """By level, from path rows; with distances of the leaf's key at each level's own key left to stream_cluster_stats."""
    stream, s = _stream(spark, d)
    last = stream.tree.paths(s).select("id", F.element_at("path", -1)["dist"].alias("dist"), F.explode(F.transform("path", lambda p: F.struct(p["level"].alias("level"), p["node_id"].alias("node_id")))).alias("p"))
    return level_stats(stream.tree, last.select(F.col("p.level").alias("level"), "id", F.col("p.node_id").alias("node_id"), "dist")).withColumn("rmse", F.round("rmse", 6))


@register(query(_S0, "SELECT CAST(level AS INTEGER) AS level, CAST(count(*) AS INTEGER) AS clusters FROM t_nodes GROUP BY level"))
def tree_level_counts(spark, d):
    return level_counts(_stream(spark, d)[0].tree, spark)


@register(query(_TSVQ, "SELECT s.size, count(l.n) AS leaves FROM range(401) s(size) LEFT JOIN (SELECT count(*) AS n FROM t_leaf GROUP BY leaf_id) l ON l.n = s.size GROUP BY s.size"))
def leaf_size_histogram(spark, d):
    tree, assigned = _tree(spark, d)
    return size_histogram(tree, assigned, 400)


@register(query(_TSVQ, "SELECT CAST(count(*) AS INTEGER) AS leaves FROM t_nodes WHERE level = 2"))
def leaf_count(spark, d):
    return leaf_counter(_tree(spark, d)[0], spark)


# choice of objects and dimensions

@register("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def subset_semijoin(spark, d):
    ids = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return subset(table(spark, d, "documents").select("doc_id", "source"), ids, "doc_id")


_HIST = "h AS (SELECT CAST(i AS INTEGER) AS dim, CAST(sum(2 * ((sig >> i) & 1) - 1) AS BIGINT) AS balance FROM sigs, range(64) t(i) GROUP BY i)"
_BALANCED = "d AS (SELECT dim, row_number() OVER (ORDER BY dim) - 1 AS place FROM (SELECT dim FROM h ORDER BY abs(balance), dim LIMIT 16))"


@register(query([SIGS, _HIST], "SELECT dim, balance FROM h"))
def dim_balance(spark, d):
    return dim_histogram(sigs(spark, d))


@register(query([SIGS, _HIST, _BALANCED], "SELECT dim FROM d"))
def balanced_quarter(spark, d):
    return spark.createDataFrame([(i,) for i in balanced_dims(sigs(spark, d), 16)], "dim int")


@register(query([SIGS, _HIST, _BALANCED], "SELECT s.id, CAST(sum(((s.sig >> d.dim) & 1) * (1 << CAST(d.place AS INTEGER))) AS BIGINT) AS word FROM sigs s, d GROUP BY s.id"))
def reduced_sigs(spark, d):
    s = sigs(spark, d)
    return reduce_dims(s, balanced_dims(s, 16)).select("id", F.col("sig")[0].alias("word"))


# archives

_ESCAPED = r"regexp_replace(CAST(content AS VARCHAR), '\\x(0A|0D|00)', ' ', 'g')"
_TITLE = rf"trim(regexp_replace(regexp_replace(regexp_extract(translate({_ESCAPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '<title>([^<]*)<.', 1), '\\x[0-9a-f][0-9a-f]', '', 'g'), '[^a-z0-9 ]', '', 'g'))"


@register(f"SELECT row_id, coalesce({_TITLE}, '') AS title FROM records WHERE map_contains(metadata, 'warc-trec-id')")
def page_titles(spark, d):
    r = table(spark, d, "records").where(has_field(F.col("metadata"), "WARC-TREC-ID"))
    return r.select("row_id", title(F.col("content")).alias("title"))


@register(f"SELECT metadata['warc-trec-id'] AS trec_id, coalesce({_TITLE}, '') AS title FROM records WHERE map_contains(metadata, 'warc-trec-id')")
def warc_titles(spark, d):
    """All records written as archives in the shared folder and read back, then the titles of the pages among them."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_warc(table(spark, d, "records"), path)
    return jobs.title_job(spark, path)


@register("SELECT row_id, metadata['warc-type'] AS warc_type, CAST(octet_length(content) AS BIGINT) AS bytes FROM records")
def record_fields(spark, d):
    return table(spark, d, "records").select("row_id", field(F.col("metadata"), "WARC-Type").alias("warc_type"), F.octet_length("content").cast("bigint").alias("bytes"))


# no SQL: sequential or seeded by other means; the K-tree is tested against a sequential model in tests/test_ktree.py

@register()
def ktree_assign(spark, d):
    return ktree(sigs(spark, d), 10)[1]


@register()
def ktree_delayed(spark, d):
    return ktree(sigs(spark, d), 10, delay=50)[1]


@register()
def experiment_grid(spark, d):
    return jobs.grid_table(jobs.experiment_grid(sigs(spark, d), [3, 4], 2, [1], 2).drop("seconds").withColumn("seconds", F.lit(None).cast("double")))


_U = "CAST(('0x' || substr(md5('{seed}:' || n || ':' || i), 1, 12)) AS BIGINT)"


@register(f"WITH b AS (SELECT n, CAST({_U.format(seed=1)} < CAST(0.25 * (1::BIGINT << 48) AS BIGINT) AS BIGINT) AS bit FROM range(1000) a(n), range(256) t(i)) SELECT n AS id, CAST(sum(bit) AS BIGINT) AS ones FROM b GROUP BY n")
def random_bits(spark, d):
    return random_signatures(spark, 1000, 256, p=0.25).select("id", bits.popcount(F.col("sig")).alias("ones"))


@register(f"SELECT n AS id, CAST(i AS INTEGER) AS dim, {_U.format(seed=1)} / CAST(1::BIGINT << 48 AS DOUBLE) AS x FROM range(100) a(n), range(8) t(i)")
def random_numbers(spark, d):
    return random_vectors(spark, 100, 8).select("id", F.posexplode("v").alias("dim", "x"))


def p5_found(spark, d):
    return find_errors(table(spark, d, "metarows"), "line_id")


def p5_rows(spark, d):
    return load_rows(table(spark, d, "metarows").drop("loaded_at"), "line_id")[0]


_CELLS = """
 checked AS (SELECT *, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') AS quoted FROM metarows),
 fields AS (SELECT *, CASE WHEN quoted THEN list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1),
     lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM checked),
 judged AS (SELECT *, CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 7 THEN 'columns'
   WHEN regexp_matches(line, '[^\\x00-\\x7f]') OR NOT regexp_full_match(f[1], 'xc12-[0-9]{4}[a-z]{2}-[0-9]{2}-[0-9]{5}')
     OR NOT regexp_full_match(f[2], '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') OR f[2] LIKE '0000%' OR try_strptime(f[2], '%Y-%m-%dT%H:%M:%SZ') IS NULL
     OR NOT regexp_full_match(f[3], 'https?://[^\\s\\x1c-\\x1f]+') OR NOT regexp_full_match(f[4], '([A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+(;.*)?)?', 's')
     OR NOT regexp_full_match(f[5], '[0-9]+') OR NOT regexp_full_match(f[6], '[1-5][0-9]{2}') OR NOT regexp_full_match(f[7], '(sha1:[A-Z2-7]{32})?')
   THEN 'value' END AS reason FROM fields)
"""

QUERIES |= {"p5_found": p5_found, "p5_rows": p5_rows}
SQL |= {
    "p5_found": f"WITH {_CELLS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_rows": f"""WITH {_CELLS} SELECT line_id, path, rec_no, f[1] AS warc_trec_id, strptime(f[2], '%Y-%m-%dT%H:%M:%SZ') AS warc_date, f[3] AS warc_target_uri,
      f[4] AS content_type, CAST(f[5] AS BIGINT) AS content_length, CAST(f[6] AS INTEGER) AS http_status, f[7] AS warc_payload_digest FROM judged WHERE reason IS NULL""",
}

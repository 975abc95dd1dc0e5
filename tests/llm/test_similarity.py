import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborsig.llm.simclusters import describe_clusters, flips, markov_clusters, probing, similarity_clusters
from arborsig.llm.vectorknn import footrule, nearest_vectors, neighbour_pairs, blocks_of

SIG = "id string, sig array<bigint>, cluster_id int, flow int"


def signed(x):
    return [int(w) for w in np.frombuffer(x.to_bytes(32, "little"), "<i8")]


def near(r, base, n):
    for b in r.sample(range(256), n):
        base ^= 1 << b
    return base


def planted(seed, sizes, chains=3, alone=60):
    r, rows = random.Random(seed), []
    for s in sizes:
        base = r.getrandbits(256)
        rows += [near(r, base, r.randint(0, 12)) for _ in range(s)]
    for _ in range(chains):  # similar to the next but not to the one after: no cluster
        a = r.getrandbits(256)
        b = a ^ ((1 << 20) - 1)
        rows += [a, b, b ^ (((1 << 20) - 1) << 30)]
    rows += [r.getrandbits(256) for _ in range(alone)]
    r.shuffle(rows)
    return [(f"s{i:04d}", x) for i, x in enumerate(rows)]


def model(rows, t=24):
    n = len(rows)
    adj = {i: {j for j in range(n) if j != i and (rows[i][1] ^ rows[j][1]).bit_count() <= t} for i in range(n)}
    return {(min(rows[j][0] for j in adj[i] | {i}), rows[i][0]) for i in range(n) if adj[i] and all(adj[j] | {j} == adj[i] | {i} for j in adj[i])}


@pytest.mark.parametrize("block, probe", [(4096, None), (7, 0), (4096, 1), (64, 1)])
def test_clusters_equal_the_model(spark, block, probe):
    rows = planted(1, [2, 2, 3, 5, 8, 40])
    rows += [(f"t{i}", rows[0][1]) for i in range(30)]  # many copies of one
    df = spark.createDataFrame([(i, signed(x), 1, 2) for i, x in rows] + [(rows[0][0], signed(rows[0][1]), 1, 2), (None, signed(5), 1, 2), ("u", None, 1, 2), ("v", [], 1, 2), ("w", [1, 2], 1, 2), ("x", [1, None, 2, 3], 1, 2)], SIG)
    found = similarity_clusters(df, block=block, probe=probe)
    assert {(r["cluster_id"], r["id"]) for r in found.collect()} == model(rows)
    sizes = {r["cluster_id"]: r for r in describe_clusters(found).collect()}
    assert all(len(r["typical_ids"]) == min(3, r["size"]) for r in sizes.values())


def test_clusters_of_parts_far_from_each_other_are_found(spark):
    r, rows = random.Random(3), []
    for k in (2, 3, 6, 12):  # parts of k near copies each, 22 to 24 bits from one another: the flow parts them
        for parts in (2, 3):
            base, places = r.getrandbits(256), r.sample(range(256), 256)
            for g in range(parts):
                far = places[:22] if parts == 2 and g else places[11 * g : 11 * g + 11] if parts == 3 else []
                rows += [(f"k{k}p{parts}g{g}i{i:02d}", base ^ sum(1 << b for b in [*far, places[100 + 30 * g + i]])) for i in range(k)]
    a = r.getrandbits(256)  # two parts that one member too far from the other keeps from being a cluster
    rows += [(f"x{i}", a ^ ((1 << 22) - 1 if i > 3 else 0) ^ (1 << 40 + i)) for i in range(8)] + [("x8", a ^ (1 << 50) - (1 << 46))]
    found = similarity_clusters(spark.createDataFrame([(i, signed(x), 1, 2) for i, x in rows], SIG))
    assert {(c["cluster_id"], c["id"]) for c in found.collect()} == model(rows) and len(model(rows)) == 115
    assert all(abs(c["sum(flow)"] - 1) < 1e-9 for c in found.groupBy("cluster_id").sum("flow").collect())


def test_typical_members_are_the_nearest_to_all_others(spark):
    r = random.Random(5)
    rows = []
    for c in range(6):
        base = r.getrandbits(256)
        rows += [(f"a{c}{i}", near(r, base, 11)) for i in range(7)] + [(f"z{c}", base)]
    found = similarity_clusters(spark.createDataFrame([(i, signed(x), 1, 2) for i, x in rows], SIG))
    shown = describe_clusters(found).collect()
    assert len(shown) == 6 and all(s["size"] == 8 and s["typical_ids"][0] == f"z{s['cluster_id'][1]}" for s in shown)
    assert all(abs(x["sum(flow)"] - 1) < 1e-9 for x in found.groupBy("cluster_id").sum("flow").collect())


def test_flow_parts_groups_that_a_single_link_joins(spark):
    groups = [range(0, 6), range(10, 16)]
    links = [(a, b, 10.0) for g in groups for a in g for b in g if a != b] + [(5, 10, 1.0), (10, 5, 1.0)]
    found = {r["cid"]: r["attractor"] for r in markov_clusters(spark.createDataFrame(links, "a bigint, b bigint, w double")).collect()}
    assert len({found[x] for x in groups[0]}) == 1 and len({found[x] for x in groups[1]}) == 1 and found[0] != found[10]


def test_probes_keep_buckets_of_unrelated_signatures_small():
    assert probing(300_000, 256, 24) == 0 and probing(10**8, 256, 24) == 1 and probing(10**11, 256, 24) == 2
    assert len(flips(10, 2)) == 1 + 10 + 45


def test_nothing_to_cluster(spark):
    assert similarity_clusters(spark.createDataFrame([], SIG)).count() == 0
    assert similarity_clusters(spark.createDataFrame([("a", signed(1), 0, 0)], SIG)).count() == 0


VEC = "id string, v array<float>, other int, dist int"


def vectors(n, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.05
    x[: n // 3] = centres[0] + rng.normal(size=(n // 3, dims)) * 0.05  # a third in one place
    return x.astype(np.float32)


def exact(x, k=10):
    x = x.astype(np.float64)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}


@pytest.mark.parametrize("file_rows", [6000, 150])
def test_nearly_all_neighbours_are_found(spark, file_rows):
    x = vectors(900)
    df = spark.createDataFrame([(f"v{i:04d}", [float(a) for a in r], 1, 2) for i, r in enumerate(x)], VEC)
    got = {(int(r["id_a"][1:]), int(r["id_b"][1:])) for r in neighbour_pairs(nearest_vectors(df, file_rows=file_rows)).collect()}
    want = exact(x)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


@pytest.mark.parametrize("exact_too", [True, False])
def test_all_neighbours_in_a_hot_third_are_found(spark, exact_too):
    x = vectors(10_000)
    df = spark.createDataFrame([(f"v{i:05d}", r.tolist(), 1, 2) for i, r in enumerate(x)], VEC)
    got = {}
    for r in nearest_vectors(df, exact=exact_too).select("id", "other").toPandas().itertuples():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    wide, hits = x.astype(np.float64), 0
    asked = [*range(0, 3333, 11), *range(3333, 10_000, 41)]
    for i in asked:
        d = ((wide - wide[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[i] & set(np.argpartition(d, 9)[:10].tolist()))
    assert hits == 10 * len(asked) if exact_too else hits >= 9.9 * len(asked)


def test_footrule_counts_places_over_the_query_s_pivots():
    # pivots 0..3, permutations of length 3: member 0 has 2 0 1, member 1 has 3 2 0
    places = np.array([[1, 2], [2, 3], [0, 1], [3, 0]], np.uint8)
    assert footrule(places, np.array([2, 0, 1])).tolist() == [0, 1 + 1 + 1]
    assert footrule(places, np.array([3, -1, 2])).tolist() == [3 + 2, 0 + 1]


def test_blocks_of_a_hot_file_are_bounded_and_meet_once(spark):
    posted = spark.range(100).select(F.lit(1).alias("file"), F.lit(3).alias("role"), F.col("id").alias("cid")).union(spark.range(5).select(F.lit(2), F.lit(3), F.col("id")))
    met, sizes = {}, {}
    for r in blocks_of(posted, 20).collect():
        sizes.setdefault((r["file"], r["ask"], r["hold"]), []).append((r["cid"], r["role"]))
    for (file, _, _), rows in sizes.items():
        for a in [c for c, role in rows if role != 2]:
            for b in [c for c, role in rows if role != 1]:
                met[(file, a, b)] = met.get((file, a, b), 0) + 1
    assert len(met) == 100 * 100 + 25 and set(met.values()) == {1}
    assert max(map(len, sizes.values())) <= 80


def test_copies_ties_and_unusable_rows(spark):
    one, two = [1.0] * 64, [2.0] * 64
    rows = [(f"a{i:02d}", one, 0, 0) for i in range(30)] + [("b", two, 0, 0), ("b", two, 0, 0), (None, one, 0, 0), ("n", None, 0, 0), ("s", [1.0], 0, 0), ("q", [float("nan")] * 64, 0, 0), ("z", [None] * 64, 0, 0), ("i", [float("inf")] * 64, 0, 0)]
    got = {}
    for r in nearest_vectors(spark.createDataFrame(rows, VEC)).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    assert set(got) == {f"a{i:02d}" for i in range(30)} | {"b"}
    assert list(got["a00"].values()) and [got["a00"][k] for k in range(1, 11)] == [f"a{i:02d}" for i in range(1, 11)]
    assert [got["b"][k] for k in range(1, 11)] == [f"a{i:02d}" for i in range(10)]


def test_few_vectors(spark):
    assert nearest_vectors(spark.createDataFrame([], VEC)).count() == 0
    assert nearest_vectors(spark.createDataFrame([("a", [0.5] * 64, 0, 0)], VEC)).count() == 0
    assert nearest_vectors(spark.createDataFrame([("a", [0.5] * 64, 0, 0), ("b", [0.1] * 64, 0, 0)], VEC)).count() == 2

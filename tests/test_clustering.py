import math
import random

import pytest
from pyspark.sql import functions as F

from arborsig.functions.distance import HAMMING
from arborsig.operators.kmeans import DistanceSeeder, KMeans, rmse
from arborsig.operators.ktree import KTreeKernel, as_tree, ktree
from arborsig.operators.seeding import distance_seeds, pick_by_weight, sample
from arborsig.operators.select import balanced_dims, dim_histogram, reduce_dims, subset
from arborsig.operators.tree import ROOT, Key, Tree, descend_joined, level_stats, size_histogram, tree_stats
from arborsig.operators.treebuild import EMTree, split_levels, tsvq
from arborsig.plans import jobs
from arborsig.streaming.streaming_emtree import MiniBatches, StreamingEMTree, run_batches


def sigs(spark, rows):
    return spark.createDataFrame([(i, [s]) for i, s in enumerate(rows)], "id bigint, sig array<bigint>")


def fixed(values):
    return lambda objects, k, by: {"": [(i, (v,)) for i, v in enumerate(values)]}


def random_sigs(spark, n, seed=0, bits=16):
    r = random.Random(seed)
    return sigs(spark, [r.getrandbits(bits) for _ in range(n)])


DATA = [0b0000, 0b0001, 0b0011, 0b1111, 0b0111]


def test_kmeans_assignment_is_that_before_the_last_recalculation(spark):
    df = sigs(spark, DATA)
    zero = KMeans(2, 0, seeder=fixed([0b0000, 0b1111])).cluster(df)
    assert [r["idx"] for r in zero.assigned.orderBy("id").collect()] == [0, 0, 0, 1, 1]
    assert round(rmse(zero), 6) == 1.095445
    one = KMeans(2, 1, seeder=fixed([0b0000, 0b1111])).cluster(df)
    assert one.keys[""] == {0: (0b0001,), 1: (0b0111,)} and round(rmse(one), 6) == 0.774597
    more = KMeans(2, -1, seeder=fixed([0b0000, 0b1111])).cluster(df)
    assert more.converged and more.rounds == 2


def test_empty_cluster_keeps_its_key_and_is_left_out_at_the_end(spark):
    found = KMeans(3, 1, seeder=fixed([0b0000, 0b0000, 0b1111])).cluster(sigs(spark, DATA))
    assert sorted(found.keys[""]) == [0, 2]
    assert {r["cluster"] for r in found.members().collect()} == {0, 1}


def test_fewer_objects_than_clusters_and_none(spark):
    assert len(KMeans(5, 0).cluster(sigs(spark, [1, 2, 4])).keys[""]) == 3
    assert KMeans(5, 2).cluster(sigs(spark, [1]).limit(0)).keys == {}


def test_enforced_number_of_clusters(spark):
    found = KMeans(4, 2, enforce=True).cluster(sigs(spark, [7] * 10))
    sizes = sorted(r["count"] for r in found.assigned.groupBy("idx").count().collect())
    assert sizes == [2, 2, 3, 3] and len(found.keys[""]) == 4


def test_sum_of_distances_never_grows(spark):
    df, last = random_sigs(spark, 200), math.inf
    for it in range(1, 5):
        total = KMeans(6, it).cluster(df).assigned.agg(F.sum("dist")).first()[0]
        assert total <= last
        last = total


def test_weighted_picks(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 4)], "id bigint, w bigint")
    assert [pick_by_weight(df, u, "id", "w")[0] for u in (0.5, 0.4, 0.0)] == [3, 2, 0]
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 4)], "id string, w bigint")
    assert [pick_by_weight(names, u, "id", "w")[0] for u in (0.5, 0.4, 0.0)] == ["d", "c", "a"]
    assert len(set(distance_seeds(random_sigs(spark, 50), 4, tries=3))) == 4
    assert len(KMeans(3, 1, seeder=DistanceSeeder()).cluster(random_sigs(spark, 40)).keys[""]) == 3


def two_level():
    keys = [Key("r.0", ROOT, 1, 0, (0,)), Key("r.1", ROOT, 1, 1, (255,)), Key("r.0.0", "r.0", 2, 0, (0,)), Key("r.0.1", "r.0", 2, 1, (7,)), Key("r.1.0", "r.1", 2, 0, (255,)), Key("r.1.1", "r.1", 2, 1, (254,))]
    return Tree(keys)


def test_prune_counts_a_subtree_once():
    tree, points = two_level().prune({"r.0.0": 2})
    assert points == 2 and [k.node_id for k in tree.keys] == ["r.0", "r.0.0"]
    assert tree.prune({"r.0.0": 2}) == (tree, 0) or tree.prune({"r.0.0": 2})[1] == 0


def test_tree_shape():
    t = two_level()
    assert (t.max_level(), t.min_level(), t.cluster_count(2), len(t.leaves()), t.size("r.0")) == (2, 2, 4, 4, 2)
    seen = []
    t.visit(lambda k: seen.append(k.node_id))
    assert seen == ["r.0", "r.0.0", "r.0.1", "r.1", "r.1.0", "r.1.1"]
    uneven = t.remove({"r.1.0", "r.1.1"})
    assert uneven.min_level() == 1 and uneven.is_leaf("r.1")
    assert [k.node_id for k in uneven.add("r.1", [(3,)]).child_keys("r.1")] == ["r.1.0"] and t.clear().is_empty()


def test_descents_agree(spark):
    df, t = random_sigs(spark, 120, bits=8), two_level()
    a = sorted(tuple(r) for r in t.descend(df).select("id", "leaf_id", "dist").collect())
    b = sorted(tuple(r) for r in descend_joined(t.frame(spark), df, 2).collect())
    assert a == b
    stats = level_stats(t, t.visits(df)).collect()
    assert sum(r["object_count"] for r in stats if r["level"] == 2) == 120


def test_two_kinds_of_new_keys_differ(spark):
    keys = [Key("r.0", ROOT, 1, 0, (0,)), Key("r.0.0", "r.0", 2, 0, (0,)), Key("r.0.1", "r.0", 2, 1, (0b111,))]
    rows = spark.createDataFrame([(0, [0b001], "r.0.0"), (1, [0b010], "r.0.0"), (2, [0b100], "r.0.0"), (3, [0b111], "r.0.1"), (4, [0b111], "r.0.1")], "id bigint, value array<bigint>, leaf_id string")
    batch = EMTree(Tree(keys), rows).rebuild_internal().tree
    assert [batch.by_id[n].value[0] for n in ("r.0.0", "r.0.1", "r.0")] == [0, 0b111, 0]
    stream = StreamingEMTree(Tree(keys))
    stream.insert(rows.select("id", F.col("value").alias("sig")))
    stream.update()
    assert stream.tree.by_id["r.0"].value[0] == 0b111


def test_accumulators_go_on_between_batches(spark):
    stream = StreamingEMTree(Tree([Key("r.0", ROOT, 1, 0, (0,))]))
    for batch, key in (([0b0011, 0b0001], 0b0001), ([0b0100], 0b0001)):
        stream.insert(sigs(spark, batch))
        stream.update()
        assert stream.tree.by_id["r.0"].value[0] == key
    assert (stream.acc["r.0"].sse, stream.object_count(), round(stream.rmse(), 6)) == (9, 3, 1.732051)
    stream.clear()
    assert math.isnan(stream.rmse())


def test_result_of_a_pass_does_not_depend_on_batches_or_partitions(spark):
    df = random_sigs(spark, 300)
    seed = split_levels(df.limit(60), [3, 3], 0)[0]
    whole, parts = StreamingEMTree(seed), StreamingEMTree(seed)
    whole.insert(df.repartition(7))
    for i in range(3):
        parts.insert(df.where(F.col("id") % 3 == i))
    assert {k: (a.count, a.sse) for k, a in whole.acc.items()} == {k: (a.count, a.sse) for k, a in parts.acc.items()}
    assert sorted(map(tuple, whole.accumulators(spark).collect())) == sorted(map(tuple, parts.accumulators(spark).collect()))
    assert run_batches(StreamingEMTree(seed), df, 128) == 3


def test_a_key_without_objects_stays_and_has_no_error(spark):
    stream = StreamingEMTree(Tree([Key("r.0", ROOT, 1, 0, (0,)), Key("r.1", ROOT, 1, 1, (255,))]))
    stream.insert(sigs(spark, [0, 1]))
    stream.update()
    assert stream.tree.by_id["r.1"].value == (255,)
    rows = {r["node_id"]: r for r in stream.cluster_stats(spark).collect()}
    assert math.isnan(rows["r.1"]["rmse"]) and rows["r.1"]["object_count"] == 0
    with pytest.raises(ValueError):
        StreamingEMTree(Tree([]))


def test_objects_are_kept_by_rearranging(spark):
    df = random_sigs(spark, 150)
    t = EMTree.seed(df, [3, 3], update_means=False)
    for step in (t.rearrange(), t.em_step(), t.rearrange_internal(), t.prune()[0]):
        assert step.assigned.count() == 150
        assert {r[0] for r in step.assigned.select("leaf_id").distinct().collect()} <= {k.node_id for k in step.tree.leaves()}
    assert t.em_step().prune()[1] == 0


def test_tsvq_levels_and_histogram(spark):
    tree, assigned = tsvq(random_sigs(spark, 100), 3, 3, 2)
    assert tree.max_level() == 2 and len(tree.leaves()) <= 9
    h = size_histogram(tree, assigned, 100).collect()
    assert len(h) == 101 and sum(r["size"] * r["leaves"] for r in h) == 100
    with pytest.raises(ValueError):
        tsvq(random_sigs(spark, 5), 3, 1)


def test_leaves_beyond_the_histogram_are_counted(spark):
    tree, assigned = tsvq(random_sigs(spark, 100), 3, 3, 2)
    h = size_histogram(tree, assigned, 3).collect()
    assert sum(r["size"] * r["leaves"] for r in h) == 100 and len({r["size"] for r in h}) == len(h) == max(r["size"] for r in h) + 1


def check_shape(kernel):
    depths, sizes = set(), []

    def walk(node, d):
        sizes.append(len(node.keys))
        if node.leaf:
            depths.add(d)
        else:
            assert len(node.keys) == len(node.children)
            for c in node.children:
                walk(c, d + 1)

    walk(kernel.root, 0)
    assert len(depths) == 1 and max(sizes) <= kernel.order


@pytest.mark.parametrize("values", [[5] * 10, list(range(40))])
def test_ktree_keeps_all_objects_at_one_depth(values):
    kernel = KTreeKernel(4 if len(set(values)) == 1 else 2)
    for i, v in enumerate(values):
        kernel.add(i, (v,))
    check_shape(kernel)
    assert kernel.count(kernel.root) == len(values)
    keys, members = kernel.rows(ROOT)
    assert sorted(m for m, _ in members) == list(range(len(values)))


def test_ktree_shards(spark):
    df = random_sigs(spark, 200)
    nodes, assigned = ktree(df, 5, delay=10, shards=3)
    assert assigned.select("id").distinct().count() == 200
    tree = as_tree(nodes)
    assert {r[0] for r in assigned.select("leaf_id").distinct().collect()} <= {k.node_id for k in tree.leaves()}
    assert jobs.ktree_job(df, 5).assigned.count() == 200


def test_subset_and_sample(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id bigint, x string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "id bigint")
    assert sorted(r["x"] for r in subset(df, ids).collect()) == ["a", "b"]
    assert sample(df, 10).count() == 4 and sample(df, 2).count() == 2


def test_balanced_dims(spark):
    df = sigs(spark, [1, 3, 7, 15])
    assert [abs(r["balance"]) for r in dim_histogram(df).orderBy("dim").limit(8).collect()] == [4, 2, 0, 2, 4, 4, 4, 4]
    assert balanced_dims(df, 2) == [1, 2]
    assert [r["sig"][0] for r in reduce_dims(df, [1, 2]).orderBy("id").collect()] == [0, 1, 3, 3]


def test_streaming_mini_batches(spark, tmp_path):
    from arborsig.sources.signatures import stream_signatures, write_signatures

    df = random_sigs(spark, 90)
    write_signatures(df.repartition(3), f"{tmp_path}/in")
    stream = StreamingEMTree(split_levels(df.limit(30), [3, 3], 0)[0])
    batches = MiniBatches(stream)
    batches.start(stream_signatures(spark, f"{tmp_path}/in"), f"{tmp_path}/state").awaitTermination()
    assert stream.object_count() == 90 and batches.last == 2
    batches.step(df.withColumn("id", F.col("id").cast("string")), 2)
    assert stream.object_count() == 90


def test_whole_jobs(spark):
    df = random_sigs(spark, 120)
    ids = spark.range(60).select("id")
    stream, visits, stats = jobs.streaming_emtree_job(df, ids, 3, 3, 2)
    assert visits.count() == 240 and stats.where("level = 1").agg(F.sum("object_count")).first()[0] == 120
    assert jobs.mini_batch_job(df, ids, 3, 3, 50)[1].count() == 240
    assert jobs.tsvq_job(df, 3).first()["objects"] == 120
    assert jobs.emtree_job(df, 3).assigned.count() == 120
    assert jobs.hybrid_job(df, 40, 3).assigned.count() == 120
    full, reduced = jobs.reduced_dims_job(df, ids, 64, 3, 2)
    assert full.assigned.count() == reduced.assigned.count() == 60
    assert jobs.repeated_kmeans(df, 3, 2, 2).assigned.count() == 120 and jobs.root_order(100) == 10
    assert tree_stats(two_level(), two_level().descend(df.limit(0))).first()["rmse"] == 0.0
    assert HAMMING.name == "hamming"


def test_grids_of_all_methods(spark):
    df = random_sigs(spark, 60)
    grid = jobs.experiment_grid(df, [4], 2, [1], 1, ["tsvq", "emtree", "kmeans", "ktree", "ktree_delayed"])
    assert grid.count() == 5 and jobs.grid_table(grid).count() == 5 and grid.where("clusters < 1 or rmse is null").count() == 0
    assert set(jobs.STUDIES) >= {"convergence", "ktree_delayed"}


def test_hash_sample(spark):
    from arborsig.operators.seeding import hash_sample

    df = spark.range(10_000).select("id")
    assert 900 < hash_sample(df, 1000, 10_000).count() < 1600 and hash_sample(df, 20_000, 10_000).count() == 10_000


def test_no_plan_gathers_all_objects_in_one_task(spark):
    from arborsig.operators.seeding import random_seeds, sample

    df = random_sigs(spark, 2000)
    for plan in (random_seeds(df, 5), random_seeds(df.withColumn("g", F.col("id") % 3), 5, by="g"), KMeans(4, 2).cluster(df).assigned, sample(df, 50)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        # a single partition is reached only by rows that a limit has cut down before
        assert "SinglePartition" not in text or "TakeOrderedAndProject" in text or "GlobalLimit" in text, text


def test_large_samples_are_the_first_by_hash(spark, monkeypatch):
    from arborsig.operators import seeding

    df = random_sigs(spark, 3000)
    want = {r["id"] for r in seeding.sample(df, 700).select("id").collect()}
    monkeypatch.setattr(seeding, "FEW", 10)
    assert {r["id"] for r in seeding.sample(df, 700).select("id").collect()} == want and len(want) == 700
    assert seeding.sample(df, 5000).count() == 3000


def test_weighted_picks_with_ids_of_a_common_prefix(spark, monkeypatch):
    from arborsig.operators import seeding

    monkeypatch.setattr(seeding, "RANGE_ROWS", 50)
    rows = [(f"clueweb09-en0000-00-{i:05d}", i % 7) for i in range(1000)]
    df = seeding.in_ranges(spark.createDataFrame(rows, "id string, w bigint"), "id")
    assert df.select("_p").distinct().count() > 5
    total, run = sum(w for _, w in rows), 0
    for u in (0.0, 0.31, 0.77, 1.0):
        run, want = 0, None
        for i, w in rows:
            run += w
            if run >= u * total:
                want = i
                break
        assert seeding.pick_by_weight(df, u, "id", "w") == (want, total)

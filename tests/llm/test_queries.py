"""Every llm query of the contract on the smallest test data: it runs, and its columns are the stated ones."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["row_id", "line_no"], "p2_found": ["cluster_id", "id"], "p2_clusters": ["cluster_id", "size", "typical_ids"], "p3_found": ["id_a", "id_b"], "p3_neighbours": ["id", "other", "dist", "rank"],
    "p4_found": ["row_id"], "p4_scores": ["row_id", "host", "spam_score"], "p6_found": ["row_id", "field"], "p6_restored": ["row_id", "field", "restored", "complete"], "p7_found": ["row_id", "lang"],
    "p7_segments": ["row_id", "page_lang", "page_confidence", "lang", "first", "number", "confidence"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "pos", "kind"], "p10_redacted": ["doc_id", "text"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)


def test_containers_are_full(spark):
    from pyspark.sql import functions as F

    df = entry.queries()["p9_containers"](spark, "/root/testdata/sf0.01")
    assert df.count() > 0
    sizes = [c for c in df.columns if c in ("size", "tokens", "n_tokens", "length")]
    if sizes and "container" in df.columns:
        used = [r[0] for r in df.groupBy("container").agg(F.sum(sizes[0])).collect()]
        assert max(used) <= 2048 and sum(used) / (2048 * len(used)) > 0.95


def test_other_languages_in_stray_lines_do_not_make_a_body_mixed(spark, langrefs):
    from arborsig.llm.language import _strays

    rows = [(i, i % 4, [i % 4, 0], [100 + i, 7]) for i in range(40)]  # pattern 7 in language 0 is on pages of all four
    rows += [(100 + i, 1, [1, 0], [200 + i, 300 + i % 5]) for i in range(10)]  # those of mixed pages are on pages of one only
    scored = spark.createDataFrame(rows, "row_id bigint, top int, tops array<int>, patterns array<bigint>")
    stray = {r["row_id"]: r["strays"] for r in _strays(scored).collect()}
    assert stray == {i: [7] for i in range(40) if i % 4}

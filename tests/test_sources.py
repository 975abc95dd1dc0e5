import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborsig.plans.jobs import title_job
from arborsig.sources.signatures import random_signatures, random_vectors, read_signatures, stream_binary, subset_ids
from arborsig.sources.sinks import write_members, write_stats, write_titles, write_visits
from arborsig.sources.warc import extract_titles, field, has_field, read_warc, title, with_field, write_warc

WARC = (
    b"\r\n\r\nWARC/0.18\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    b"WARC/0.18\r\nWARC-TREC-ID: first\r\nno colon here\r\n\r\nx: 1\r\nX: 2\r\ncontent-LENGTH: 52\r\n\r\n"
    b"<HTML><TITLE>Hello,\nWorld!  2</TITLE><p>something</p>\r\n"
    b"WARC/0.18\r\nWARC-TREC-ID: cut\r\nContent-Length: 1000\r\n\r\n<title>never ends"
)


@pytest.mark.parametrize("name,pack", [("a.warc", lambda b: b), ("b.warc.gz", gzip.compress), ("c.warc.bz2", bz2.compress), ("d.tgz", gzip.compress)])
def test_archives(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(WARC))
    rows = read_warc(spark, f"{tmp_path}/{name}").orderBy("rec_no").collect()
    assert [r["metadata"].get("warc-trec-id") for r in rows] == [None, "first", "cut"]
    assert rows[1]["metadata"]["x"] == "2" and rows[2]["content"] == b"<title>never ends"
    titles = {r["trec_id"]: r["title"] for r in extract_titles(read_warc(spark, f"{tmp_path}/{name}")).collect()}
    assert titles == {"first": "hello world  2", "cut": ""}
    write_titles(title_job(spark, f"{tmp_path}/{name}"), f"{tmp_path}/titles")


@pytest.mark.parametrize("page,want", [(b"<HTML><TITLE>Hello,\nWorld!  2</TITLE>", "hello world  2"), (b'<title lang="x">A</title>', ""), (b"none", ""), (b"", ""), (None, ""), (b"<title>x<", ""), ("<title>Ä\0b</title>".encode(), "b")])
def test_titles(spark, page, want):
    assert spark.createDataFrame([(page,)], "content binary").select(title(F.col("content")).alias("t")).first()["t"].strip() == want


def test_metadata_keys_in_any_case(spark):
    df = spark.createDataFrame([({"a": "1"},), (None,)], "m map<string,string>")
    m = F.col("m")
    rows = df.select(field(m, "A").alias("f"), has_field(m, "A").alias("h"), with_field(m, "B", F.lit("2"))["b"].alias("w")).collect()
    assert [tuple(r) for r in rows] == [("1", True, "2"), (None, False, "2")]


def test_signature_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, size=(5, 2))
    (tmp_path / "ids").write_text("".join(f"d{i}\n" for i in range(5)))
    (tmp_path / "sigs").write_bytes(x.astype("<i8").tobytes())
    rows = read_signatures(spark, f"{tmp_path}/ids", f"{tmp_path}/sigs", 128).orderBy("n").collect()
    assert [r["id"] for r in rows] == [f"d{i}" for i in range(5)] and [r["sig"] for r in rows] == x.tolist()
    assert read_signatures(spark, f"{tmp_path}/ids", f"{tmp_path}/sigs", 128, 3).count() == 3
    assert subset_ids(spark, f"{tmp_path}/ids").count() == 5
    with pytest.raises(ValueError):
        read_signatures(spark, "x", "y", 100)
    with pytest.raises(Exception):
        read_signatures(spark, f"{tmp_path}/no", f"{tmp_path}/none", 128).count()
    (tmp_path / "short").write_bytes(x[:3].astype("<i8").tobytes())
    with pytest.raises(Exception, match="no signature"):
        read_signatures(spark, f"{tmp_path}/ids", f"{tmp_path}/short", 128).collect()


def test_generators_repeat(spark):
    a = random_signatures(spark, 500, 256, p=0.25)
    assert a.collect() == random_signatures(spark, 500, 256, p=0.25).collect()
    ones = a.select(F.expr("aggregate(sig, 0L, (s, w) -> s + bit_count(w))").alias("n")).agg(F.avg("n")).first()[0]
    assert 58 < ones < 70
    assert all(0 <= x < 1 for r in random_vectors(spark, 20, 4).collect() for x in r["v"])


def test_sinks(spark, tmp_path):
    visits = spark.createDataFrame([(1, 7, "r.0", 3)], "level int, id bigint, node_id string, dist bigint")
    write_visits(visits, f"{tmp_path}/x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x_clusters").columns[:3] == ["object ID", "cluster ID", "distance to cluster center"]
    write_stats(spark.createDataFrame([(1, "r", "r.0", 1.5, 2)], "level int, parent_id string, node_id string, rmse double, object_count bigint"), f"{tmp_path}/x")
    write_members(spark.createDataFrame([(7, 0)], "id bigint, cluster int"), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first()[0] == "7 0"


def test_archives_written_are_read_again(spark, tmp_path):
    rows = [({"warc-trec-id": "a", "content-length": "99", "x": "1\n2"}, bytes(range(256))), (None, b"plain"), ({"warc-trec-id": "b", "y": None}, None), ({}, b"")]
    write_warc(spark.createDataFrame(rows, "metadata map<string,string>, content binary"), f"{tmp_path}/w")
    got = {(r["metadata"].get("warc-trec-id"), bytes(r["content"])) for r in read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {("a", bytes(range(256))), (None, b"plain"), ("b", b""), (None, b"")}
    assert {r["metadata"].get("x") for r in read_warc(spark, f"{tmp_path}/w", whole=0).collect()} == {"1 2", None}  # streamed


def test_binary_stream_with_a_limit(spark, tmp_path):
    x = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, size=(12, 2))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.sig").write_bytes(x[4 * i : 4 * i + 4].astype("<i8").tobytes())
    q = stream_binary(spark, f"{tmp_path}/in", 128, most=3).writeStream.format("memory").queryName("sigs_in").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r["path"][-5], r["n"], r["sig"]) for r in spark.table("sigs_in").collect())
    assert got == [(str(i), n, x[4 * i + n].tolist()) for i in range(3) for n in range(3)]

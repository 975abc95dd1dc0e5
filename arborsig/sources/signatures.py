"""Sources of signatures: headerless binary files with a list of ids, and generators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bits import words_of


@dataclass(frozen=True)
class Preset:
    """Files of a known collection: ids, signatures, bits."""

    ids: str
    signatures: str
    bits: int = 4096


# Names of the files of known collections.
WIKIPEDIA = Preset("wiki.4096.docids", "wiki.4096.sig")
CLUEWEB = Preset("clueweb.4096.docids", "clueweb.4096.signatures")


def read_signatures(spark: SparkSession, ids_path: str, sig_path: str, bits: int, most: int = -1) -> DataFrame:
    """(n, id, sig): line n of the ids with record n of the signatures, the first ``most`` or all (-1).

    Records are ``bits`` / 8 bytes of little-endian words.  Files that don't exist are an error, and so are ids without
    a signature.  Best converted to Parquet once.
    """
    size = 8 * words_of(bits)
    sc = spark.sparkContext
    records = sc.binaryRecords(sig_path, size)
    if most >= 0:  # nothing behind the limit is unpacked
        records = records.zipWithIndex().filter(lambda r: r[1] < most).map(lambda r: r[0])
    sigs = _numbered(spark.createDataFrame(records.map(lambda r: (r,)), "raw binary"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i8")
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size // 8, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), sig], names=["n", "sig"])

    lines = _numbered(spark.read.text(ids_path).withColumnRenamed("value", "id"))
    if most >= 0:
        lines = lines.where(F.col("n") < most)
    both = lines.join(sigs.select("n", "raw").mapInArrow(words, "n bigint, sig array<bigint>"), "n", "left")
    return both.select("n", "id", F.when(F.col("sig").isNotNull(), F.col("sig")).otherwise(F.raise_error(F.lit("an id has no signature")).cast("array<bigint>")).alias("sig"))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``n``, the rows' numbers in the order of the file: counts of partitions first, then rows inside them.

    ``monotonically_increasing_id`` holds the partition and the place in it; only a row a partition is collected.
    """
    spark = df.sparkSession
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33).cast("int")
    at, before = 0, []
    for p, c in sorted((r["p"], r["count"]) for r in tagged.groupBy(part.alias("p")).count().collect()):
        before.append((p, at))
        at += c
    offsets = F.broadcast(spark.createDataFrame(before, "_p int, _o bigint"))
    return tagged.withColumn("_p", part).join(offsets, "_p").withColumn("n", F.col("_o") + F.expr("_m & 8589934591")).drop("_m", "_p", "_o")


def read_preset(spark: SparkSession, folder: str, preset: Preset, most: int = -1) -> DataFrame:
    return read_signatures(spark, f"{folder}/{preset.ids}", f"{folder}/{preset.signatures}", preset.bits, most)


def stream_signatures(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A streaming DataFrame (id, sig) over Parquet files of signatures, so many files a batch."""
    return spark.readStream.schema("id string, sig array<bigint>").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_binary(spark: SparkSession, folder: str, bits: int, most: int = -1, files_per_batch: int = 1) -> DataFrame:
    """A streaming DataFrame (path, n, sig) over headerless files of signatures, so many files a batch; ``n`` counts from
    0 in each file, of which the first ``most`` records or all (-1) are read.  Bytes after the last whole record are an error.

    A file is a batch's unit of work and is held by a task: cut collections into files of some hundred megabytes.
    """
    size = 8 * words_of(bits)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                buffer = raw.as_buffer()
                if buffer.size % size:
                    raise ValueError(f"{path} ends within a record")
                n = buffer.size // size if most < 0 else min(most, buffer.size // size)
                for s in range(0, n, 10_000):
                    e = min(n, s + 10_000)
                    flat = np.frombuffer(buffer, dtype="<i8", count=(e - s) * size // 8, offset=s * size)
                    sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size // 8, dtype=np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * (e - s)), pa.array(np.arange(s, e)), sig], names=["path", "n", "sig"])

    return files.select("path", "content").mapInArrow(words, "path string, n bigint, sig array<bigint>")


def write_signatures(df: DataFrame, path: str, id: str = "id", value: str = "sig") -> None:
    """Signatures as Parquet in the columns that ``stream_signatures`` reads."""
    df.select(F.col(id).cast("string").alias("id"), F.col(value).alias("sig")).write.mode("overwrite").parquet(path)


def subset_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) from a file with an id a line."""
    return spark.read.text(path).select(F.col("value").alias("id"))


def _uniform(seed: int, i: Column) -> Column:
    """48 bits of the md5 of seed, row and place: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("n").cast("string"), F.lit(":"), i.cast("string"))), 1, 12), 16, 10).cast("bigint")


def random_signatures(spark: SparkSession, n: int, bits: int, seed: int = 1, p: float = 0.5) -> DataFrame:
    """(id, sig): ``n`` signatures whose bits are on with probability ``p``, the same for the same seed.

    For p = 1/2 a word is a hash; otherwise each bit compares a hash with p.
    """
    count = words_of(bits)
    if p == 0.5:
        sig = F.array(*[F.xxhash64(F.col("n"), F.lit(w), F.lit(seed)) for w in range(count)])
    else:
        limit = int(p * (1 << 48))
        bit = lambda w, i: F.when(_uniform(seed, F.lit(64 * w) + i) < limit, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
        word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(w, i)))
        sig = F.array(*[word(w) for w in range(count)])
    return spark.range(n).select(F.col("id").alias("n")).select(F.col("n").alias("id"), sig.alias("sig"))


def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 1) -> DataFrame:
    """(id, v): ``n`` vectors of numbers in [0, 1), the same for the same seed."""
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: _uniform(seed, i) / float(1 << 48))
    return spark.range(n).select(F.col("id").alias("n")).select(F.col("n").alias("id"), v.alias("v"))

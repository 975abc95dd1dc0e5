"""Web archives, compressed or not, as rows of metadata and content, and the titles of the pages in them."""

from __future__ import annotations

import bz2
import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORDS = "path string, rec_no bigint, metadata map<string,string>, content binary"
OPENERS = {"gz": gzip.open, "tgz": gzip.open, "gzip": gzip.open, "bz2": bz2.open, "bzip2": bz2.open}


def open_archive(path: str, raw: BinaryIO | None = None) -> BinaryIO:
    """The archive's bytes, unpacked by its file name's ending; ``raw`` are its packed bytes, else it is a local file."""
    opener = OPENERS.get(path.rpartition(".")[2].lower())
    if opener:
        return opener(raw if raw is not None else path, "rb")
    return raw if raw is not None else open(path, "rb")


class Chunks(io.RawIOBase):
    """A stream over pieces of bytes that come one after another, so that no file is held whole."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(to), len(self.rest))
        to[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def read_records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(metadata, content) of each record.

    Header lines are ``key: value``, keys in any case (kept in small letters), later ones overriding; lines without a
    colon are passed over.  A header ends at the first blank line after its content-length; blank lines before that are
    tolerated.  A record cut off by the end of the file keeps what is there; a header without content-length that the
    end cuts off is no record.
    """
    while True:
        meta: dict[str, str] = {}
        while True:
            line = f.readline()
            if not line:
                return
            text = line.decode("utf-8", "replace").strip()
            if not text:
                if "content-length" in meta:
                    break
                continue
            key, colon, value = text.partition(":")
            if colon:
                meta[key.strip().lower()] = value.strip()
        try:
            size = max(0, int(meta["content-length"]))
        except ValueError:
            size = 0
        yield meta, f.read(size)


#: Archives up to this size go through Spark's own file reader; larger ones, which don't fit a cell, are streamed.
WHOLE = 512 << 20


def read_warc(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, rec_no, metadata, content) of the records of the archives that ``path`` names, folders and patterns too.

    Any file system that Spark reads will do.  An archive is read by one task, several in parallel.  Archives larger than
    ``whole`` bytes are streamed through the file system's Arrow driver, or from the local disk; where neither is
    there, that is an error.  An empty archive has no records.
    """
    files = spark.read.format("binaryFile").load(path)
    n = files.count()
    spread = lambda df: df.repartition(max(1, min(n, 100_000)), "path")

    def batches_of(p: str, f: BinaryIO) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for i, (meta, content) in enumerate(read_records(f), 1):
            held.append((p, i, meta, content))
            size += len(content)
            if size > 8_000_000 or len(held) >= 1000:
                yield pd.DataFrame(held, columns=["path", "rec_no", "metadata", "content"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "rec_no", "metadata", "content"])

    def held_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("rec_no", pa.int64()), ("metadata", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1)):
                with open_archive(p, io.BytesIO(raw.as_buffer())) as f:
                    for out in batches_of(p, f):
                        rows = [[*out["path"]], [*out["rec_no"]], [list(m.items()) for m in out["metadata"]], [*out["content"]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with open_archive(p, stream(p)) as f:
                    yield from batches_of(p, f)

    small = spread(files.where(F.col("length") <= whole).select("path", "content")).mapInArrow(held_whole, RECORDS)
    large = spread(files.where(F.col("length") > whole).select("path")).mapInPandas(streamed, RECORDS)
    return small.unionByName(large)


def stream(path: str) -> BinaryIO:
    """A file's bytes as a stream, from the local disk or through an Arrow file system."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub("^file:(?://)?", "", path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    return io.BufferedReader(Chunks(iter(lambda f=system.open_input_stream(at): f.read(1 << 20) or None, None)), 1 << 20)


def write_warc(records: DataFrame, path: str) -> None:
    """Records (metadata, content) as gzipped archives in the folder ``path``, one a partition.

    Null content is written as empty; a content-length in the metadata is replaced by the true one.
    """
    meta = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (F.lower(k) != "content-length"))
    lines = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(e["value"], r"\s+", " ")))
    content = F.coalesce("content", F.lit(b""))
    head = F.concat_ws("\r\n", lines, F.concat(F.lit("content-length: "), F.octet_length(content).cast("string")), F.lit("\r\n"))
    # a record's bytes pass through the text writer as they are; what it puts behind each is the end of a record
    records.select(F.concat(head.cast("binary"), content).cast("string").alias("value")).write.mode("overwrite").option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def field(metadata: Column, key: str) -> Column:
    """A metadata value by its key in any case; null if there is none."""
    return metadata[key.lower()]


def has_field(metadata: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(metadata, key.lower()), F.lit(False))


def with_field(metadata: Column, key: str, value: Column) -> Column:
    """The metadata with a value set."""
    return F.map_concat(F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != key.lower()), F.create_map(F.lit(key.lower()), value))


def title(content: Column) -> Column:
    """The title in a page's bytes: ASCII letters in small, line ends and zero bytes as blanks, only ASCII letters,
    digits and blanks kept.  Empty if there is no ``<title>`` without attributes that ends before the last byte."""
    text = F.decode(content, "ISO-8859-1")
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\r\0", "abcdefghijklmnopqrstuvwxyz   ")
    cut = plain.substr(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(0)))
    found = F.regexp_extract(cut, "<title>([^<]*)<", 1)
    return F.coalesce(F.trim(F.regexp_replace(found, "[^a-z0-9 ]", "")), F.lit(""))


def extract_titles(records: DataFrame) -> DataFrame:
    """(trec_id, title) of the records that have a ``warc-trec-id``."""
    return records.where(has_field(F.col("metadata"), "warc-trec-id")).select(field(F.col("metadata"), "warc-trec-id").alias("trec_id"), title(F.col("content")).alias("title"))

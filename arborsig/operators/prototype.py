"""Prototypes of groups of objects: the strict majority of bits, the mean of numbers, weighted or not.

A kernel adds up each partition's objects by group first where a group has many; what is shuffled are these sums, and the
few objects of the other groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import from_arrow


def bit_rows(words: np.ndarray) -> np.ndarray:
    """The bits of rows of words as a matrix of 0 and 1."""
    x = np.ascontiguousarray(words.astype("<i8", copy=False))
    return np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")


#: Objects a task holds before it sends on what it has.
HELD = 20_000
#: Bits sums of so many objects or more are sent as sums, of fewer as the objects themselves, which are then smaller.
FEW = 16
#: How a row holds its numbers: sums as float64 or int32, or objects as words.
FLOATS, INTS, WORDS = 0, 1, 2


class Sums:
    """Counts, weights, errors and sums by dimension of groups, sent on in parts: at most ``HELD`` objects are held.

    Groups with many objects in a part are added up first, so a hot group is small wherever it goes; of groups with few,
    as in a tree with more leaves than a task has objects, the objects are sent.
    """

    SCHEMA = "g string, n bigint, w double, sse double, kind tinyint, s binary"

    def __init__(self, bits: bool):
        self.bits, self.held, self.rows, self.counts = bits, [], 0, []

    def add(self, groups, x: np.ndarray, w: np.ndarray | None = None, errors: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Takes objects (words of bits or numbers); groups without a name don't count."""
        self.held.append((np.asarray(groups, dtype=object), x, w, errors))
        self.rows += len(x)
        if self.rows >= HELD:
            yield from self.flush()

    def count(self, group: str, n: int) -> None:
        """Adds to a group's number only."""
        self.counts.append((group, n, 0.0, 0.0, WORDS if self.bits else FLOATS, b""))

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, self.counts = self.counts, []
        if self.rows:
            groups, x = np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held])
            w = np.concatenate([h[2] for h in self.held]) if self.held[0][2] is not None else None
            errors = np.concatenate([h[3] for h in self.held]) if self.held[0][3] is not None else np.zeros(len(x))
            codes, names = pd.factorize(groups)
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(names) + 1))
            x, errors = x[order], np.asarray(errors, dtype=np.float64)[order]
            w = w[order] if w is not None else None
            for k, g in enumerate(names):
                a, b = cuts[k], cuts[k + 1]
                weight = float(b - a) if w is None else float(w[a:b].sum())
                if not self.bits:
                    kind, s = FLOATS, (x[a:b].sum(0) if w is None else w[a:b] @ x[a:b]).astype("<f8")
                elif w is not None:
                    kind, s = FLOATS, (w[a:b] @ bit_rows(x[a:b])).astype("<f8")
                elif b - a >= FEW:
                    kind, s = INTS, bit_sums(x[a:b])
                else:
                    kind, s = WORDS, x[a:b]
                rows.append((g, int(b - a), weight, float(errors[a:b].sum()), kind, s.tobytes()))
        self.held, self.rows = [], 0
        if rows:
            g, n, w, e, kind, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(e, pa.float64()), pa.array(kind, pa.int8()), pa.array(s, pa.binary())], names=["g", "n", "w", "sse", "kind", "s"])


def bit_sums(words: np.ndarray) -> np.ndarray:
    """The number of rows with each bit on, as int32."""
    out = np.zeros(words.shape[1] * 64, np.int32)
    for s in range(0, len(words), 255):  # so many fit a byte
        out += bit_rows(words[s : s + 255]).sum(0, dtype=np.uint8)
    return out


def _added(p: pd.DataFrame) -> np.ndarray | None:
    """The sum of the parts of a group however they are held; None if there are only counts."""
    total, raw = None, []
    for kind, n, s in zip(p["kind"], p["n"], p["s"]):
        if not s:
            continue
        if kind == WORDS:
            raw.append(np.frombuffer(s, dtype="<i8").reshape(n, -1))
            continue
        x = np.frombuffer(s, dtype="<f8" if kind == FLOATS else "<i4")
        total = x.copy() if total is None else total + x
    if raw:
        x = bit_sums(np.concatenate(raw))
        total = x if total is None else total + x
    return total


def _merged(parts: DataFrame, groups: int | None, finish, schema: str) -> DataFrame:
    """(g, n, w, sse, ...): the parts of each group as one.  A call gets about 32 groups; without their number as many
    calls are made as there are shuffle partitions."""
    slots = max(1, -(-groups // 32)) if groups else int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, q in p.groupby("g", sort=False):
            out.append((g, q["n"].sum(), q["w"].sum(), q["sse"].sum(), finish(_added(q), q["w"].sum())))
        return pd.DataFrame(out, columns=["g", "n", "w", "sse", "x"])

    return parts.groupBy(F.pmod(F.xxhash64("g"), F.lit(slots))).applyInPandas(run, f"g string, n bigint, w double, sse double, x {schema}")


def merged_sums(parts: DataFrame, groups: int | None = None) -> DataFrame:
    """(g, n, w, sse, kind, s): the parts of each group as one, in the form of ``Sums.SCHEMA``."""
    merged = _merged(parts, groups, lambda s, _: None if s is None else (FLOATS if s.dtype.kind == "f" else INTS, s.tobytes()), "struct<kind:tinyint,s:binary>")
    return merged.where("x is not null").select("g", "n", "w", "sse", "x.kind", "x.s")


def merged_prototypes(parts: DataFrame, groups: int | None, bits: bool) -> DataFrame:
    """(g, n, w, sse, key): each group's strict majority or mean, worked out where its parts come together."""
    finish = (lambda s, w: None if s is None else list(majority_words(s, w))) if bits else (lambda s, w: None if s is None else s / w)
    return _merged(parts, groups, finish, "array<bigint>" if bits else "array<double>").withColumnRenamed("x", "key")


def _parts(objects: DataFrame, group: str, value: str, weight: str | None, bits: bool) -> tuple[DataFrame, str]:
    rows = objects.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).alias("v"), *([F.col(weight).cast("double").alias("w")] if weight else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(bits)
        for b in batches:
            if b.num_rows:
                yield from sums.add(b.column(0).to_pandas().to_numpy(), from_arrow(b.column(1), np.int64 if bits else np.float64), b.column(2).to_numpy(zero_copy_only=False) if weight else None)
        yield from sums.flush()

    return rows.mapInArrow(run, Sums.SCHEMA), objects.schema[group].dataType.simpleString()


def accumulate(objects: DataFrame, group: str, value: str = "sig", weight: str | None = None, bits: bool = True) -> DataFrame:
    """(group, count, weight, sums): for each group the number of objects, their weight and the sums by dimension.

    Objects with a null value or group don't count.  Weights default to 1.
    """
    parts, kind = _parts(objects, group, value, weight, bits)
    merged = _merged(parts, None, lambda s, _: s.astype(np.float64), "array<double>")
    return merged.select(F.col("g").cast(kind).alias(group), F.col("n").alias("count"), F.col("w").alias("weight"), F.col("x").alias("sums"))


def majority(sums: Column, total: Column) -> Column:
    """A signature with 1 where more than half of the weight has 1; a tie gives 0."""
    words = F.sequence(F.lit(0), (F.size(sums) / 64 - 1).cast("int"))
    places = F.sequence(F.lit(0), F.lit(63))
    bit = lambda w, i: F.when(2 * F.get(sums, w * 64 + i) > total, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    return F.transform(words, lambda w: F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(w, i))))


def prototypes(objects: DataFrame, group: str, value: str = "sig", weight: str | None = None, bits: bool = True) -> DataFrame:
    """(group, count, key): each group's majority signature or mean vector.  Groups without objects don't appear."""
    parts, kind = _parts(objects, group, value, weight, bits)
    return merged_prototypes(parts, None, bits).select(F.col("g").cast(kind).alias(group), F.col("n").alias("count"), "key")


def majority_words(sums: np.ndarray, total: float) -> tuple[int, ...]:
    """As ``majority``, for sums held by the driver."""
    on = (2 * np.asarray(sums) > total).astype(np.uint8)
    return tuple(int(w) for w in np.packbits(on, bitorder="little").view("<i8"))

"""Choice of objects by a list of ids, and of dimensions by their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bits
from .prototype import accumulate


def subset(df: DataFrame, ids: DataFrame, id: str = "id", other: str | None = None) -> DataFrame:
    """The rows of ``df`` whose id is among ``ids``; repeated rows stay, repeated ids don't multiply them, null ids match
    nothing."""
    wanted = ids.select(F.col(other or id).alias("_wanted"))
    return df.join(wanted, df[id] == wanted["_wanted"], "left_semi")


def dim_histogram(df: DataFrame, value: str = "sig") -> DataFrame:
    """(dim, balance): for each bit the number of objects that have it less the number that don't."""
    acc = accumulate(df.withColumn("_g", F.lit(0)), "_g", value)
    return acc.select("count", F.posexplode("sums").alias("dim", "ones")).select("dim", (2 * F.col("ones") - F.col("count")).cast("bigint").alias("balance"))


def balanced_dims(df: DataFrame, keep: int, value: str = "sig") -> list[int]:
    """The ``keep`` bits that are nearest to being on in half of the objects, the lower of equal ones, in their order."""
    return sorted(r["dim"] for r in dim_histogram(df, value).orderBy(F.abs("balance"), "dim").limit(keep).collect())


def reduce_dims(df: DataFrame, dims: list[int], value: str = "sig") -> DataFrame:
    """``df`` with ``value`` cut down to these bits, in ascending order."""
    return df.withColumn(value, bits.gather(F.col(value), sorted(dims)))


def error_to_mean_and_first(df: DataFrame, id: str = "id", value: str = "sig") -> DataFrame:
    """One row: (mean_error, first_error), the mean distance to the majority signature and to the first object's."""
    from ..functions.distance import HAMMING
    from .nearest import literal
    from .prototype import prototypes

    key = prototypes(df.withColumn("_g", F.lit(0)), "_g", value).first()
    first = df.where(F.col(value).isNotNull()).orderBy(id).select(value).first()
    if key is None or first is None:
        return df.sparkSession.createDataFrame([(None, None)], "mean_error double, first_error double")
    to = lambda k: F.avg(HAMMING.column(F.col(value), literal(k, HAMMING)))
    return df.agg(to(key["key"]).alias("mean_error"), to(first[0]).alias("first_error"))

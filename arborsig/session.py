"""Session helpers shared by all operators: table access, durable lineage cuts, input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on a local master, as in tests, is a temporary folder used where the session names none; on a cluster that is
    an error, as another machine's folder would be lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = getattr(sc, "_arborsig_dir", None)
        if made is None:
            made = sc._arborsig_dir = tempfile.mkdtemp(prefix="arborsig-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, its lineage cut; survives the loss of an executor.  For narrow rows."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder: as ``durable``, for wide rows of which later steps read parts;
    with ``by`` a folder a value of that column.

    The session's tables are deleted when the program ends.
    """
    spark = df.sparkSession
    folder = getattr(spark.sparkContext, "_arborsig_tables", None)
    if folder is None:
        folder = spark.sparkContext._arborsig_tables = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    (write.partitionBy(by) if by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already: its folder is the cluster's to clean up
        pass


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for operators bound by CPU.

    A scan that is already split finely enough, as any large one is, stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(per_core * cores)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once for each Spark context."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_arborsig_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="arborsig-code-")) / "arborsig.zip"  # Spark copies it to the executors itself
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    to.write_bytes(held.getvalue())
    sc.addPyFile(str(to))
    sc._arborsig_shipped = True

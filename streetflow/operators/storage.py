"""Lineage cuts and size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest side that may be broadcast, in bytes of its rows as text: an upper bound of their size in memory, roughly.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/streetflow-{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a run's folder through the file system it lies on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on earlier stages, so a lost executor costs a re-read and not a
    re-run, and its row count comes from the file footers.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its row count, observed while writing: no second job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def cut_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``cut_lineage`` with the row count."""
    path = run_dir(df.sparkSession, label)
    n = write_counted(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), n


def cut_summed(df: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """``cut_lineage`` with the row count and a checksum that does not depend on the order of rows."""
    path, seen = run_dir(df.sparkSession, label), Observation()
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("sum")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["sum"])


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Hint a broadcast only if all rows together have at most ``max_bytes``.

    ``df`` is computed once: its size is summed up while it is written, and both plans read what was written.
    """
    path, seen = run_dir(df.sparkSession, "side"), Observation()
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).cast("long"))
    df.observe(seen, size.alias("bytes")).write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return (F.broadcast(kept), True) if (seen.get["bytes"] or 0) <= max_bytes else (kept, False)

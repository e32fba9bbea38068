"""Overlaps, segments and trips saved in buckets by trip, so that reports group and join them where they lie.

Tables of the same number of buckets meet without a shuffle on ``trip_key``. Bands are partitions: one band is replaced
without touching the others, and a band filter reads its files only. A trip is never large, whereas a single street may
hold much of a table; reports by street therefore sum up per trip first, in place, and shuffle those sums alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.operators.storage import run_dir

KEY = "trip_key"
BUCKETS = 64


def trip_key() -> Column:
    """A trip within its band, as one column: buckets cannot be made of a partition column."""
    return F.concat_ws("/", "band", "trip_id")


def _laid_out(df: DataFrame, buckets: int) -> DataFrame:
    # the writer's buckets are these partitions, so each writes one file per band
    return df.withColumn(KEY, trip_key()).repartition(buckets, KEY)


def save(df: DataFrame, label: str, buckets: int = BUCKETS, name: str | None = None, path: str | None = None) -> str:
    """Write rows of (band, trip_id, …) as a new table and return its name; by default one of its own in the shared folder."""
    name = name or f"streetflow_{label}_{uuid.uuid4().hex}"
    writer = _laid_out(df, buckets).write.format("parquet").option("path", path or run_dir(df.sparkSession, label))
    writer.partitionBy("band").bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name)
    return name


def refresh(df: DataFrame, name: str) -> None:
    """Replace the bands that ``df`` holds rows of; the table's other bands stay as they are."""
    spark = df.sparkSession
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    mode = "spark.sql.sources.partitionOverwriteMode"  # the write takes it from the session alone
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        _laid_out(df, buckets).select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def saved(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)

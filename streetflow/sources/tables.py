"""Parquet tables: reading, materialising, copying, typed inserts, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core some rows when the input has fewer splits than the cluster has cores.

    Lines are far larger than the keys they come from, so this moves the small rows before they grow.
    Inputs with enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table by the result of a query."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_trips(df: DataFrame, path: str) -> None:
    """Trips are laid out by band so that a band filter prunes files."""
    write_table(df, path, ["band"])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a declared schema: cast what exists, NULL for what does not."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def insert_into(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a table of a declared schema."""
    conform(df, schema).write.mode("append").parquet(path)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def copy_table(spark: SparkSession, source: str, target: str, partition_by: list[str] | None = None) -> DataFrame:
    """Copy a Parquet table to another location without passing rows through the driver."""
    write_table(spark.read.parquet(source), target, partition_by)
    return spark.read.parquet(target)

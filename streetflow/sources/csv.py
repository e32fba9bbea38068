"""CSV with a header: typed, all-text, many files at once, and writing."""

from __future__ import annotations

import csv
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetflow.schema import BANDS


def files_by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names to the files that start with them. One line per file comes to the driver, as file names do."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(tuple(next(csv.reader([row["line"].lstrip("﻿")]), [])), []).append(unquote(row["file"]))
    return found


def _read(spark: SparkSession, path: str | list[str], also: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """All files as text, columns aligned by the names in each file's own header; a column a file lacks is NULL."""
    out = None
    for files in files_by_header(spark, path).values():
        part = spark.read.csv(files, header=True, inferSchema=False)
        for name, column in (also or {}).items():
            part = part.withColumn(name, column())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.read.csv(path, header=True, inferSchema=False) if out is None else out


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Typed by an explicit schema matched on the header: no pass over the values to infer one.

    Columns are taken by name in each file, so files may order them differently or lack some.
    """
    text = _read(spark, path)
    return text.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as text."""
    return _read(spark, path)


def read_banded_csv(spark: SparkSession, root: str, pattern: str = "csv_files/*.csv",
                    bands: list[str] | None = None) -> DataFrame:
    """Union of ``root/<band>/csv_files/*.csv`` as text, ``band`` taken from the path."""
    paths = [f"{root}/{b}/{pattern}" for b in bands or BANDS]
    return _read(spark, paths, {
        "band": lambda: F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+/[^/]+$", 1)})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

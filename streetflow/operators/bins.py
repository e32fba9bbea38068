"""Histograms and survival curves as one aggregate over bounded bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 1000


def all_bins(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").alias("bin"))


def right_closed(v: Column, width: int) -> Column:
    """i such that i/width < v <= (i+1)/width, corrected for rounding by testing the edges themselves."""
    guess = F.ceil(v * width) - 1
    return (F.when(v <= guess / width, guess - 1).when(v > (guess + 1) / width, guess + 1)
            .otherwise(guess)).cast("long")


def left_closed(v: Column, width: int) -> Column:
    """i such that i/width <= v < (i+1)/width."""
    guess = F.floor(v * width)
    return (F.when(v < guess / width, guess - 1).when(v >= (guess + 1) / width, guess + 1)
            .otherwise(guess)).cast("long")


def with_empty_bins(counts: DataFrame, first: int, last: int) -> DataFrame:
    """Every bin from first to last, count 0 where no row fell."""
    grid = all_bins(counts.sparkSession, first, last)
    return grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def survival(df: DataFrame, columns: dict[str, Column], steps: int = STEPS) -> DataFrame:
    """For i = 0..steps: the share of rows whose value is at least i/steps, one curve per column.

    One pass counts rows per (curve, bucket); the curve is a reverse running sum over at most
    ``steps + 1`` buckets. Rows with a NULL value stay in the denominator.
    """
    def bucket(v):
        at = left_closed(v, steps)
        return F.when(v.isNull() | (at < 0), -1).when(at > steps, steps).otherwise(at).cast("long")

    pairs = F.array(*[F.struct(F.lit(n).alias("curve"), bucket(c).alias("bin")) for n, c in columns.items()])
    counts = (
        df.select(F.explode(pairs).alias("p")).groupBy("p.curve", "p.bin").agg(F.count("*").alias("n")))
    per_curve = counts.groupBy("bin").agg(*[
        F.sum(F.when(F.col("curve") == n, F.col("n"))).alias(n) for n in columns])
    # Bucket -1 holds what lies on no curve; it counts in the total only.
    full = all_bins(df.sparkSession, -1, steps).join(per_curve, "bin", "left")
    down, whole = W.orderBy(F.col("bin").desc()), W.partitionBy()
    curves = full.select("bin", *[
        F.try_divide(F.coalesce(F.sum(n).over(down), F.lit(0)), F.sum(n).over(whole)).alias(n) for n in columns])
    return curves.filter(F.col("bin") >= 0).select("bin", (F.col("bin") / steps).alias("break"), *columns)

"""Detour ratio: cleaning, loop removal, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streetflow.functions import text as T
from streetflow.operators import bins
from streetflow.operators.quantiles import exact_quantiles
from streetflow.schema import (
    LOOP_FACTOR,
    LOOP_OD_M,
    MIN_RATIO,
    MIN_TRIP_M,
    ROUTE_NUMERIC,
    SAFE_RATIO_RANGE,
)


def clean_routes(merged: DataFrame) -> DataFrame:
    """All-text result rows to numbers; ``safe_ratio`` drops the router's failure markers."""
    numeric = {c: T.number(F.col(c)) for c in ROUTE_NUMERIC if c in merged.columns}
    return merged.withColumn("safe_ratio", T.safe_ratio(F.col("dist_ratio"))).withColumns(numeric)


def loops(routes: DataFrame) -> DataFrame:
    """Round trips: ends close together, ride more than three times that far."""
    return routes.filter((F.col("od_line_dist") < LOOP_OD_M) & (F.col("dist_calc") > LOOP_FACTOR * F.col("od_line_dist")))


def without_loops(routes: DataFrame) -> DataFrame:
    """Drop every row of a trip that has a loop row."""
    return routes.join(loops(routes).select("trip_id").distinct(), "trip_id", "left_anti")


def nonloop_trips(routes: DataFrame) -> DataFrame:
    return without_loops(routes).filter((F.col("dist_calc") > MIN_TRIP_M) & (F.col("dist_ratio") >= MIN_RATIO))


def below_network_length(routes: DataFrame) -> DataFrame:
    """Long enough non-loop trips shorter than their modelled path."""
    return without_loops(routes).filter((F.col("dist_calc") > MIN_TRIP_M) & (F.col("dist_ratio") < MIN_RATIO))


def ratio_near_one(pairs: DataFrame) -> DataFrame:
    """How many trips of each band have their modelled length."""
    ratio = F.col("dist_ratio")
    return pairs.groupBy("band").agg(
        F.count("*").alias("trips"),
        F.count(F.when((ratio > 0.99999) & (ratio < 1.00002), 1)).alias("near_one"))


def valid_ratio(routes: DataFrame, column: str = "safe_ratio") -> DataFrame:
    low, high = SAFE_RATIO_RANGE
    return routes.filter((F.col(column) > low) & (F.col(column) < high))


def detour_histogram(routes: DataFrame, column: str = "safe_ratio") -> DataFrame:
    """Share of trips per 0.01-wide bin, bins centred on multiples of the width and right-closed."""
    # A bin centred on i/100 is ((2i-1)/200, (2i+1)/200], that is 2i-1 or 2i in half-width bins.
    half = bins.right_closed(F.col(column), 200)
    binned = valid_ratio(routes, column).select(F.floor((half + 1) / 2).cast("long").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    # The valid range bounds the number of bins, so one window over them is small for any input.
    total = F.sum("n").over(W.partitionBy())
    return counts.select((F.col("bin") / 100).alias("ratio"), "n", F.try_divide(F.col("n"), total).alias("share"))


def detour_bins_rel(routes: DataFrame, column: str = "dist_ratio") -> DataFrame:
    """Relative frequency in the 302 right-closed bins from 0.98, each keyed by its lower edge."""
    at = bins.right_closed(F.col(column), 100)
    # Bin 97 collects everything outside the range: it belongs to the total only.
    counts = (
        routes.select(F.when(at.between(98, 399), at).otherwise(97).alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n")))
    shared = bins.with_empty_bins(counts, 97, 399).withColumn(
        "share", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())))
    return shared.filter(F.col("bin") >= 98).select((F.col("bin") / 100).alias("lower"), "share")


def detour_bins_count(routes: DataFrame, column: str = "safe_ratio") -> DataFrame:
    """Trips in the 402 left-closed bins 0.98 ... 4.99."""
    counts = (
        valid_ratio(routes, column).select(bins.left_closed(F.col(column), 100).alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n")))
    return bins.with_empty_bins(counts, 98, 499).select(
        (F.col("bin") / 100).alias("lower"), F.col("n").alias("trips"))


def detour_quantiles(routes: DataFrame, column: str = "safe_ratio") -> DataFrame:
    return exact_quantiles(
        valid_ratio(routes), [], column, [0.0, 0.25, 0.5, 0.75, 1.0],
        ["q0", "q25", "q50", "q75", "q100"], mean="mean", count="n")

"""Shares of trip length by stress class, over trips and by type of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.operators.bins import survival
from streetflow.schema import BANDS, DETOUR_RATIO, DIRECT_RATIO, PEAK_HOURS, STRESS_CLASSES

LENGTHS = [f"len_{c}" for c in STRESS_CLASSES]
SH_LENGTHS = [f"sh_len_{c}" for c in STRESS_CLASSES]
DAY_TYPES = ["weekend", "weekday_peak", "weekday_nonpeak"]


def with_shares(pairs: DataFrame) -> DataFrame:
    """NULL lengths to zero, then shares of the trip's length, as far as the lengths are there."""
    filled = pairs.na.fill(0.0, subset=[c for c in LENGTHS + SH_LENGTHS if c in pairs.columns])
    if not set(LENGTHS) <= set(pairs.columns):
        return filled
    d = F.col("dist_calc")
    groups = {
        "len_1_p": ["1"], "len_2_p": ["2"], "len_1_11_p": ["1", "11"],
        "len_1_2_11_p": ["1", "2", "11"], "len_3_p": ["3"], "len_4_p": ["4"],
    }

    def total(classes):
        first, *rest = [F.col(f"len_{c}") for c in classes]
        return sum(rest, first)

    return filled.withColumns({name: F.try_divide(total(cs), d) for name, cs in groups.items()})


def first_per_trip(pairs: DataFrame) -> DataFrame:
    """Keep a trip's row from the earliest band.

    An aggregate with map-side combine: no window has to hold all rows of a trip id.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col("band"))
    rest = [c for c in pairs.columns if c != "trip_id"]
    row = F.struct(*rest)
    return (
        pairs.groupBy("trip_id").agg(F.min(F.struct(order.alias("o"), row.alias("r"))).alias("m"))
        .select("trip_id", "m.r.*"))


def study_pairs(pairs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per trip. Only ``columns`` (default: all but the line) go through the keep-first aggregate, so that
    what nobody asks for, overlaps above all, is never computed."""
    if columns is not None:
        pairs = pairs.select("trip_id", "band", *[c for c in columns if c not in ("trip_id", "band")])
    return first_per_trip(with_shares(pairs.drop("geom")))


def direct_trips(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("dist_ratio") <= DIRECT_RATIO)


def low_stress_curve(pairs: DataFrame) -> DataFrame:
    """Share of direct trips with at least i/1000 of their length on low-stress streets."""
    return survival(direct_trips(study_pairs(pairs, ["dist_calc", "dist_ratio", *LENGTHS])), {
        "lts_2_less": F.col("len_1_2_11_p"), "lts_1_less": F.col("len_1_11_p")})


def stress_totals(pairs: DataFrame) -> DataFrame:
    """Metres of direct trips by class, actual and shortest, in one scan."""
    return direct_trips(study_pairs(pairs)).agg(
        *[F.sum(c).alias(c) for c in LENGTHS + SH_LENGTHS],
        F.sum("dist_calc").alias("dist_calc"), F.sum("sh_net_dist_calc").alias("sh_net_dist_calc"),
        F.count("*").alias("trips"))


def day_type(start_time: Column) -> Column:
    """Weekend, weekday peak or weekday non-peak; without a time the trip counts as non-peak."""
    weekend = F.date_format(start_time, "EEEE").isin("Saturday", "Sunday")
    peak = F.hour(start_time).isin(*PEAK_HOURS)
    return F.when(weekend, DAY_TYPES[0]).when(peak, DAY_TYPES[1]).otherwise(DAY_TYPES[2])


def trips_by_daytype(pairs: DataFrame) -> DataFrame:
    return (
        study_pairs(pairs, ["start_time"]).groupBy(day_type(F.col("start_time")).alias("day_type"))
        .agg(F.count("*").alias("trips")))


def stress_share_by_daytype(pairs: DataFrame) -> DataFrame:
    """Length-weighted class shares, three day types by two detour classes, in one aggregate."""
    ratio = F.col("dist_ratio")
    detour = F.when(ratio <= DIRECT_RATIO, "125").when(ratio > DETOUR_RATIO, "200")
    return (
        study_pairs(pairs, ["start_time", "dist_calc", "dist_ratio", *LENGTHS])
        .select(day_type(F.col("start_time")).alias("day_type"), detour.alias("detour"), "dist_calc", *LENGTHS)
        .filter(F.col("detour").isNotNull())
        .groupBy("day_type", "detour")
        .agg(*[F.try_divide(F.sum(c), F.sum("dist_calc")).alias(c) for c in LENGTHS]))


def stress_share_table(pairs: DataFrame) -> DataFrame:
    """The same as a table: one row per class, one column per day type and detour class."""
    short = dict(zip(DAY_TYPES, ["wnd", "wp", "wnp"]))
    shares = stress_share_by_daytype(pairs)
    long = shares.unpivot(["day_type", "detour"], LENGTHS, "lts", "share")
    return long.groupBy(F.regexp_replace("lts", "len_", "").alias("lts")).agg(*[
        F.max(F.when((F.col("day_type") == d) & (F.col("detour") == r), F.col("share"))).alias(f"{short[d]}_{r}")
        for d in DAY_TYPES for r in ("125", "200")])

"""Column types and the fixed values shared by all plans."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)

# They must equal the published analysis for results to agree.
BANDS = ["00_140", "141_320", "321_384", "384_500"]
STRESS_CLASSES = ["1", "2", "3", "4", "11"]
BUFFER_M = 2.0
OVERLAP_MIN_M2 = 50.0
SEGMENT_MIN_M = 10.0
MATCHING_ERROR_MAX = 70
QUARTERS = ["q2_2018", "q3_2018", "q4_2018", "q1_2019", "q2_2019", "q3_2019"]
LOOP_OD_M = 401
LOOP_FACTOR = 3
MIN_TRIP_M = 100
MIN_RATIO = 0.99
RATIO_SENTINELS = ["-999999", "inf"]
SAFE_RATIO_RANGE = (0.98, 1000)
DIRECT_RATIO = 1.25
DETOUR_RATIO = 2
PEAK_HOURS = [7, 8, 9, 16, 17, 18]

# Columns of the merged routing-result files that arrive as text.
ROUTE_NUMERIC = [
    "dist_calc", "od_line_dist", "matching_error",
    "lon_o", "lat_o", "lon_d", "lat_d", "f_distance", "dist_ratio",
]
ROUTE_CSV = T.StructType(
    [T.StructField("trip_id", T.StringType()), T.StructField("propulsion_type", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ROUTE_NUMERIC]
)

ENDPOINT_CSV = T.StructType([
    T.StructField("trip_id", T.StringType()),
    T.StructField("dist_calc", T.DoubleType()),
    T.StructField("od_line_dist", T.DoubleType()),
    T.StructField("matching_error", T.DoubleType()),
    T.StructField("propulsion_type", T.StringType()),
    T.StructField("matched_start", T.StringType()),
    T.StructField("matched_end", T.StringType()),
])

PAIR_CSV = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("propulsion_type", T.StringType()),
        T.StructField("dist_calc", T.DoubleType()),
        T.StructField("start_time", T.TimestampNTZType()),
    ]
    + [T.StructField(f"len_{c}", T.DoubleType()) for c in STRESS_CLASSES]
    + [T.StructField("sh_net_dist_calc", T.DoubleType()), T.StructField("dist_ratio", T.DoubleType())]
    + [T.StructField(f"sh_len_{c}", T.DoubleType()) for c in STRESS_CLASSES]
)

# One direction segment: a two-vertex piece of a trip inside one street buffer.
DIRECTION_SEGMENT = T.StructType([
    T.StructField("band", T.StringType()),
    T.StructField("osm_id", T.StringType()),
    T.StructField("way_key", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("highway", T.StringType()),
    T.StructField("lanes", T.StringType()),
    T.StructField("trip_id", T.StringType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("propulsion_type", T.StringType()),
    T.StructField("geom", LINE),
    T.StructField("angle", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("f2", T.DoubleType()),
    T.StructField("angle_mod", T.DoubleType()),
    T.StructField("angle_mod_1", T.DoubleType()),
    T.StructField("seg_len", T.DoubleType()),
])

"""GeoJSON feature collections in and out.

A collection is written as text parts, a feature per line, that concatenate to one document. Nothing is gathered, so
the size of the data does not matter. Documents of other tools are read whole, one per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetflow.functions import projection as P
from streetflow.operators.storage import broadcast_if_small, cut_lineage

# The property names and order of an exported route.
PROPERTIES = [
    "trip_id", "dist_calc", "f_distance", "dist_ratio", "propulsion_type",
    "lat_o", "lon_o", "lat_d", "lon_d",
]
FEATURE_TYPE = "feature"

ROUTE_PROPERTIES = T.StructType([
    T.StructField(p, T.StringType() if p in ("trip_id", "propulsion_type") else T.DoubleType())
    for p in PROPERTIES])


def collection_schema(properties: T.StructType) -> T.StructType:
    feature = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])),
        T.StructField("properties", properties)])
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature))])


def feature_json(line: str = "geom", properties: list[str] | None = None):
    """A feature as JSON text: a LineString and its properties; absent numbers are left out."""
    return F.to_json(F.struct(
        F.lit(FEATURE_TYPE).alias("type"),
        F.struct(
            F.lit("LineString").alias("type"),
            F.transform(F.col(line), lambda p: F.array(p["x"], p["y"])).alias("coordinates")).alias("geometry"),
        F.struct(*(properties or PROPERTIES)).alias("properties")))


#: Parts of a written collection in the order of their names: what precedes the features, the features, what follows.
HEAD, BODY, TAIL = "0-head", "1-body", "2-tail"


def write_geojson(df: DataFrame, path: str, line: str = "geom", properties: list[str] | None = None,
                  by: list[str] | None = None) -> None:
    """One FeatureCollection per value of ``by`` (one in all by default), lines as they are in ``line``.

    A collection is a folder of text parts, whatever its size: a head with the first feature, the others one per line
    with a comma before each, and a tail. Concatenated in the order of their names they are one valid document;
    read line by line they need no document in one piece. Features are numbered once; finding the first ones reads
    nothing but the numbers. Without ``by``, an empty table makes a collection without features.
    """
    keys = by or []
    body = df.select(*keys, feature_json(line, properties).alias("value"))
    body = cut_lineage(body.withColumn("at", F.monotonically_increasing_id()), "features")
    first, _ = broadcast_if_small(body.groupBy(*keys).agg(F.min("at").alias("first")))
    opening = '{"type":"FeatureCollection","features":['
    is_first = F.col("first").isNotNull()
    rows = body.join(first.select("first"), F.col("at") == F.col("first"), "left").select(
        *keys, F.when(is_first, HEAD).otherwise(BODY).alias("part"),
        F.concat(F.when(is_first, opening + "\n").otherwise(","), "value").alias("value"))
    bare = first.filter(~is_first).select(*keys, F.lit(HEAD).alias("part"), F.lit(opening).alias("value"))
    tail = first.select(*keys, F.lit(TAIL).alias("part"), F.lit("]}").alias("value"))
    rows.unionByName(bare).unionByName(tail).write.mode("overwrite").partitionBy(*keys, "part").text(path)


def read_geojson_lines(spark: SparkSession, path: str, properties: T.StructType = ROUTE_PROPERTIES) -> DataFrame:
    """All features of collections that ``write_geojson`` has written, with their keys; any task takes any lines."""
    lines = spark.read.text(path)
    keys = [c for c in lines.columns if c not in ("value", "part")]
    feature = collection_schema(properties)["features"].dataType.elementType
    text = F.when(F.startswith("value", F.lit(",")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    features = lines.where(F.startswith("value", F.lit(",")) | F.startswith("value", F.lit('{"type":"feature"'))).select(
        *keys, F.from_json(text, feature).alias("f"))
    return _flatten(features, keys)


def read_geojson(spark: SparkSession, path: str | list[str], properties: T.StructType = ROUTE_PROPERTIES) -> DataFrame:
    """All features of a folder of FeatureCollection documents, one document per file."""
    docs = spark.read.schema(collection_schema(properties)).json(path, multiLine=True)
    return _flatten(docs.select(F.explode("features").alias("f")))


def _flatten(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return features.select(
        *(keys or []), F.col("f.type").alias("type"), "f.properties.*",
        F.transform("f.geometry.coordinates", lambda c: F.struct(
            F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))).alias("geom"))


def merge_geojson(spark: SparkSession, path: str, out: str, by: list[str],
                  properties: T.StructType = ROUTE_PROPERTIES) -> None:
    """The many collections below ``path`` rewritten as one per value of ``by``, in one pass."""
    write_geojson(read_geojson_lines(spark, path, properties), out, properties=properties.fieldNames(), by=by)


def load_projected(spark: SparkSession, path: str, table: str, properties: T.StructType = ROUTE_PROPERTIES) -> DataFrame:
    """GeoJSON in degrees to a Parquet table in metres."""
    lines = read_geojson_lines(spark, path, properties).withColumn("geom", P.line_to_metric(F.col("geom")))
    lines.write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)

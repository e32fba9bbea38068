"""Street classification from tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag patterns and class lists of the published rules.
NOT_FOR_BIKES = ["proposed", "construction", "footway", "path", "pedestrian", "steps", "bridleway", "platform"]
BIKE_ALLOWED = ["yes", "designated", "official", "permissive", "destination"]
BIKE_FORBIDDEN_TAG = '%bicycle"=>"no"%'
CYCLEWAY_NONE_TAG = "%cycleway:both%no%"
CLOSED_CLASSES = ["motorway", "motorway_link", "trunk", "unclassified"]
NOT_A_STREET_TAGS = [
    "power", "cable", "ownership", "boundary", "water", "railway",
    "barrier", "fence", "underground", "pipeline",
]


def tag_rule(ways: DataFrame) -> DataFrame:
    """``cycle`` = noncycleable for foot-only classes without a bicycle permission, or explicit bans."""
    allowed = F.lower("other_tags").rlike("|".join(f'bicycle"=>"{v}' for v in BIKE_ALLOWED))
    foot_only = F.col("highway").isin(*NOT_FOR_BIKES) & ~allowed
    banned = F.col("other_tags").ilike(BIKE_FORBIDDEN_TAG) | F.col("other_tags").ilike(CYCLEWAY_NONE_TAG)
    return ways.withColumn("cycle", F.when(foot_only | banned, "noncycleable"))


def loose_tag_rule(ways: DataFrame) -> DataFrame:
    """``cycle_1`` = noncycleable only where a bicycle ban is tagged."""
    return ways.withColumn("cycle_1", F.when(F.col("other_tags").ilike(BIKE_FORBIDDEN_TAG), "noncycleable"))


def loose_network(ways: DataFrame) -> DataFrame:
    """Streets that are not prohibited, or not banned: the condition applied to the stress column."""
    return loose_tag_rule(ways).filter((F.col("stress_lev") != "prohibited") | F.col("cycle_1").isNull())


def class_rule(ways: DataFrame) -> DataFrame:
    """``cycle`` = noncycleable by road class or the bicycle column."""
    return ways.withColumn(
        "cycle", F.when(F.col("highway").isin(*CLOSED_CLASSES) | (F.col("bicycle") == "no"), "noncycleable"))


def cycleway_network(ways: DataFrame) -> DataFrame:
    """Streets of the cycling network. As in SQL, NULL tags drop the row."""
    tags, highway = F.col("other_tags"), F.col("highway")
    return ways.filter(
        highway.isNotNull()
        & (~F.col("bicycle").ilike("no") | F.col("bicycle").isNull())
        & ~tags.ilike('%boundary"=>"administrative%') & ~tags.ilike('%railway"=>%')
        & ~highway.ilike("motor%") & ~highway.ilike("trunk"))


def with_cycleable(ways: DataFrame) -> DataFrame:
    """``cycleable`` = not for class-4 features that are no streets; NULL elsewhere."""
    odd = F.col("highway").isNull()
    for word in NOT_A_STREET_TAGS:
        odd = odd | F.col("other_tags").ilike(f"%{word}%")
    kept = ways.drop("cycleable")
    return kept.withColumn("cycleable", F.when((F.col("lts") == "4") & odd, "not"))


def reset_cycleable(ways: DataFrame) -> DataFrame:
    """Clear the flag on every class but 4; a NULL class keeps what it has."""
    return ways.withColumn("cycleable", F.when(F.col("lts") != "4", None).otherwise(F.col("cycleable")))


def interstate_classes(ways: DataFrame) -> DataFrame:
    return ways.filter(F.col("other_tags").ilike("%interstate%")).select("stress_lev").distinct()


def ridden(ways: DataFrame) -> DataFrame:
    """Streets kept for matching."""
    return ways.filter(F.col("cycleable").isNull())


def one_way(ways: DataFrame) -> DataFrame:
    return ridden(ways).filter(F.col("oneway") == "yes")


def is_simple_one_way() -> Column:
    """One-way, undivided, named, and neither a big road, a service road, a cycleway nor a circle."""
    highway, name = F.col("highway"), F.col("name")
    return (
        (F.col("oneway") == "yes") & F.col("divided_oneway").isNull()
        & ~highway.ilike("motorway%") & ~highway.ilike("trunk%")
        & ~highway.ilike("service") & ~highway.ilike("cycleway")
        & name.isNotNull() & ~name.ilike("%circle%"))


def is_divided() -> Column:
    return F.col("divided_oneway") == "yes"


def is_rest() -> Column:
    """Two-way streets of the cycling network."""
    tags = F.col("other_tags")
    return (
        (F.col("oneway").isNull() | (F.col("oneway") != "yes"))
        & F.col("divided_oneway").isNull() & F.col("cycleable").isNull()
        & ~F.col("highway").ilike("motorway%")
        & ~tags.ilike('%railway"=>%') & ~tags.ilike('%boundary"=>%') & ~tags.ilike("%barrier%"))


def copy_class(target: DataFrame, source: DataFrame, key: str = "osm_id", column: str = "lts") -> DataFrame:
    """Update-from join: ``column`` of the matching source row, as integer; other rows keep theirs.

    The source is reduced to one row per key first (the update would pick any of several; here the
    least), so the join cannot fan out.
    """
    one = source.groupBy(key).agg(
        F.min(F.col(column).try_cast("int")).alias("_new"), F.lit(True).alias("_hit"))
    old = F.col(column) if column in target.columns else F.lit(None).cast("int")
    joined = target.join(one, key, "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(old)).drop("_new", "_hit")

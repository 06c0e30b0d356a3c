"""Place attributes from planning areas: containment, names and zone flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.operators.spatial import point_in_polygon


def planning_areas(places: DataFrame, zones: DataFrame, key: str = "poi_id", x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Add planning_area (upper case), subzone, cbd_flag and central_area_flag to each place.

    ``zones`` has planning_area, subzone and rings. Only exact containment counts; of several
    zones the first subzone name wins. A place outside all zones gets '' names and 0 flags.
    """
    bare = places.drop("planning_area", "subzone", "cbd_flag", "central_area_flag")
    placed = point_in_polygon(bare, key, x, y, zones, rings, "subzone", ["planning_area", "subzone"])
    area = F.upper(F.coalesce("planning_area", F.lit("")))
    return placed.withColumn("planning_area", area).withColumns({
        "subzone": F.coalesce("subzone", F.lit("")),
        "cbd_flag": F.col("planning_area").isin(K.CORE_AREAS).cast("int"),
        "central_area_flag": F.col("planning_area").isin(K.CENTRAL_AREAS).cast("int"),
    })


def unmatched(placed: DataFrame, key: str = "poi_id") -> DataFrame:
    """Ids of the places outside all zones."""
    return placed.filter("planning_area = ''").select(key)


def match_summary(placed: DataFrame) -> DataFrame:
    """Numbers of places, matched and unmatched ones, one row."""
    hit = F.count_if(F.col("planning_area") != "")
    return placed.agg(F.count(F.lit(1)).alias("places"), hit.alias("matched"), (F.count(F.lit(1)) - hit).alias("unmatched"))

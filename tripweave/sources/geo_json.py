"""GeoJSON features, paged search results, and map elements as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.functions.text import parse_latlon
from tripweave.operators.reshape import with_constants

POINT = "struct<x: double, y: double>"


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "Polygon") -> DataFrame:
    """Features of a GeoJSON file: the properties plus ``rings`` (polygons) or ``lon, lat`` (points).

    ``properties`` is a DDL field list, so nothing is inferred.
    """
    schema = f"features array<{feature_type(properties, geometry)}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return parse_features(raw.select("features"), geometry)


def feature_type(properties: str, geometry: str) -> str:
    """DDL type of one feature."""
    nested = {"Point": "array<double>", "Polygon": "array<array<array<double>>>",
              "MultiPolygon": "array<array<array<array<double>>>>"}[geometry]
    return f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: {nested}>>"


def read_feature_lines(spark: SparkSession, path: str, properties: str, geometry: str = "Polygon") -> DataFrame:
    """Newline-delimited features, as ``sinks.write_features`` writes them: files split over tasks.

    Prefer it to one large collection, which a single task has to read.
    """
    lines = spark.read.text(path).select(F.from_json("value", feature_type(properties, geometry)).alias("f"))
    return parse_features(lines.select(F.array("f").alias("features")), geometry)


def parse_features(raw: DataFrame, geometry: str) -> DataFrame:
    """Explode a ``features`` array column into one row per feature."""
    one = raw.select(F.explode("features").alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    if geometry == "Point":
        shape = [F.get(coordinates, F.lit(0)).alias("lon"), F.get(coordinates, F.lit(1)).alias("lat")]
    else:
        polygons = F.array(coordinates) if geometry == "Polygon" else coordinates
        outer = F.transform(polygons, lambda p: _points(p[0]))
        holes = F.flatten(F.transform(polygons, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), _points)))
        shape = [geo.orient(outer, holes).alias("rings")]
    return one.select("f.properties.*", *shape)


def parse_search_results(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of ``SrchResults``; entries without NAME or LatLng are page metadata and go."""
    one = raw.select(F.explode("SrchResults").alias("r")).filter(
        F.col("r.NAME").isNotNull() & F.col("r.LatLng").isNotNull()
    )
    return one.select(
        F.col("r.NAME").alias("name"), *[F.col(f"r.{c}") for c in extra], parse_latlon(F.col("r.LatLng")).alias("_p")
    ).select("name", *extra, "_p.lat", "_p.lon")


def read_search_results(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """Saved pages of a search service."""
    fields = ", ".join(f"{c}: string" for c in ["NAME", "LatLng", *extra])
    raw = spark.read.schema(f"SrchResults array<struct<{fields}>>").option("multiLine", True).json(path)
    return parse_search_results(raw, extra)


def labelled_places(df: DataFrame, prefix: str, constants: Mapping[str, object]) -> DataFrame:
    """Places of one source with its constants and a repeatable id."""
    from tripweave.functions.text import surrogate_key

    keyed = df.withColumn("poi_id", surrogate_key(prefix, F.col("name"), F.col("lat").cast("string"), F.col("lon").cast("string")))
    return with_constants(keyed, constants)


ELEMENT_SCHEMA = (
    "elements array<struct<type: string, id: bigint, tags: map<string, string>, lat: double, lon: double, "
    "geometry: array<struct<lat: double, lon: double>>, "
    "members: array<struct<role: string, geometry: array<struct<lat: double, lon: double>>>>>>"
)
NODE_RADIUS_DEG = 0.0002
TAGS = ("name", "amenity", "leisure", "tourism", "shop", "building")


def parse_elements(elements: DataFrame) -> DataFrame:
    """Map elements (one row each: type, id, tags, lat, lon, geometry, members) to polygons.

    A way must be closed with at least 4 points, a relation contributes its outer rings, a
    node becomes a small disc. Elements without tags or usable geometry are dropped.
    """

    def ring(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))

    line = F.col("geometry")
    closed = (F.size(line) >= 4) & (F.element_at(line, 1) == F.element_at(line, -1))
    outer = F.transform(
        F.filter(F.col("members"), lambda m: (m["role"] == "outer") & (F.size(m["geometry"]) >= 4)), lambda m: ring(m["geometry"])
    )
    none = F.array().cast(f"array<array<{POINT}>>")
    disc = geo.regular_ring(F.col("lon"), F.col("lat"), NODE_RADIUS_DEG)
    rings = (
        F.when((F.col("type") == "way") & closed, F.array(ring(line)))
        .when((F.col("type") == "relation") & (F.size(outer) > 0), outer)
        .when((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(disc))
    )
    shaped = elements.filter(F.col("tags").isNotNull() & (F.size("tags") > 0)).withColumn("_rings", rings)
    return shaped.filter(F.col("_rings").isNotNull()).select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"),
        *[F.coalesce(F.try_element_at("tags", F.lit(t)), F.lit("")).alias(t) for t in TAGS],
        geo.orient(F.col("_rings"), none).alias("rings"),
    )


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Saved map-service responses."""
    raw = spark.read.schema(ELEMENT_SCHEMA).option("multiLine", True).json(path)
    return parse_elements(raw.select(F.explode("elements").alias("e")).select("e.*"))


def project_rings(rings: Column) -> Column:
    """Rings in degrees (x = lon, y = lat) to grid metres."""

    def point(p: Column) -> Column:
        m = geo.to_metric(p["y"], p["x"])
        return F.struct(m["x_m"].alias("x"), m["y_m"].alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))

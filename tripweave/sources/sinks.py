"""Writers. Each is one distributed write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)


def fixed_precision(df: DataFrame, digits: int = 15) -> DataFrame:
    """Floating columns as text with a fixed number of decimals."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_fixed_csv(df: DataFrame, path: str, digits: int = 15) -> None:
    """CSV whose floating columns keep ``digits`` decimals; NULL stays empty."""
    shown = fixed_precision(df, digits)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            shown = shown.withColumn(f.name, F.when(F.col(f.name) != "null", F.col(f.name)))
    write_csv(shown, path)


def write_report(tables: Mapping[str, DataFrame], base: str) -> None:
    """A multi-table report: one Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append a batch; every part file carries its own header, so readers see one table."""
    df.write.mode("append").option("header", True).csv(path)


def feature_json(rings: Column, properties: Sequence[str]) -> Column:
    """One GeoJSON feature per row from rings and property columns."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )


def point_json(x: Column, y: Column, properties: Sequence[str]) -> Column:
    """One GeoJSON point feature per row."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
            F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_features(df: DataFrame, feature: Column, path: str) -> None:
    """Newline-delimited GeoJSON."""
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def lookup_json(sectors: DataFrame, areas: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One JSON document: sector -> area and area -> metrics, NULLs kept.

    For lookup tables (two-digit sectors, named areas): the document is one value and must fit
    a task. ``lookup_lines`` has no such bound.
    """
    sector_map = sectors.groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lpad(F.col("postal_sector").cast("string"), 2, "0").alias("k"), F.col("planning_area").alias("v"))))).alias("a")
    )
    area_map = areas.groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("planning_area").alias("k"), F.struct(*metrics).alias("v"))))).alias("b")
    )
    return sector_map.crossJoin(area_map).select(
        F.to_json(
            F.struct(F.col("a").alias("postal_to_planning_area"), F.col("b").alias("planning_area_accessibility")),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def lookup_lines(sectors: DataFrame, areas: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The same lookup as one JSON line per sector and per area, NULLs kept; any size."""
    keep = {"ignoreNullFields": "false"}
    code = F.lpad(F.col("postal_sector").cast("string"), 2, "0")
    lines = sectors.select(F.to_json(F.struct(code.alias("postal_sector"), "planning_area"), keep).alias("value"))
    return lines.unionByName(areas.select(F.to_json(F.struct("planning_area", F.struct(*metrics).alias("accessibility")), keep).alias("value")))

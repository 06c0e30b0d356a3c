"""Saved route documents as skim rows.

Readers give (file, body); ``parse_*`` work on any table with those columns, so the same
code serves batch folders, streams and tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.costs import fare_amount, kilometres, minutes

# --- fixed values: file-name patterns ---
TRANSIT_NAME = r"O+_(\d+).*?(\d+_[A-Z]+_\d+)_PT\.json$"
DRIVE_NAME = r"O+_(\d+).*?(\d+_[A-Z]+_\d+)_DRIVE\.json$"
ERROR_NAME = r"ERROR_O+_(\d+).*?(\d+_[A-Z]+_\d+)\.json$"

TRANSIT_SCHEMA = (
    "status string, plan struct<itineraries: array<struct<duration: double, transitTime: double, walkTime: double, "
    "waitingTime: double, transfers: int, fare: string, legs: array<struct<distance: double>>>>>, _corrupt_record string"
)
DRIVE_SCHEMA = "status string, status_message string, route_summary struct<total_time: double, total_distance: double>, _corrupt_record string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder tree as (file, body)."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("body"))


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same folder as a stream of new files."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("body"))


def with_route_keys(docs: DataFrame, pattern: str) -> DataFrame:
    """Add origin_id, dest_id and is_error from the file name; other names are dropped."""
    name = F.col("file")
    good, bad = name.rlike(pattern), name.rlike(ERROR_NAME)

    def part(i: int) -> Column:
        return F.when(good, F.regexp_extract(name, pattern, i)).otherwise(F.regexp_extract(name, ERROR_NAME, i))

    return docs.filter(good | bad).select(
        "*", F.concat(F.lit("O_"), part(1)).alias("origin_id"), part(2).alias("dest_id"), (~good).alias("is_error")
    )


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Add ``_d``, the parsed body, by an explode: no filter is pushed below it, so each body is made and parsed once."""
    return rows.withColumn("_d", F.explode(F.array(F.from_json("body", schema))))


def parse_transit(docs: DataFrame) -> DataFrame:
    """Public-transport skims: first itinerary only, distances summed over legs.

    Status: ``HTTP_n`` for an error body, ``NO_ITINERARY``, ``BAD_JSON`` or ``OK``. Only OK
    rows carry figures; the others have zeros.
    """
    rows = _parsed(with_route_keys(docs, TRANSIT_NAME), TRANSIT_SCHEMA)
    corrupt = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull()
    trip = F.get(F.col("_d.plan.itineraries"), F.lit(0))
    status = (
        F.when(corrupt, "BAD_JSON")
        .when(F.col("_d.status").isNotNull(), F.concat(F.lit("HTTP_"), F.col("_d.status")))
        .when(trip.isNull(), "NO_ITINERARY").otherwise("OK")
    )
    rows = rows.withColumn("error_code", status).withColumn("_t", F.when(F.col("error_code") == "OK", trip))
    metres = F.aggregate(F.coalesce(F.col("_t.legs"), F.array()), F.lit(0.0), lambda acc, leg: acc + F.coalesce(leg["distance"], F.lit(0.0)))
    fare = fare_amount(F.col("_t.fare"))
    ok = F.col("error_code") == "OK"
    return rows.select(
        "origin_id", "dest_id", minutes(F.col("_t.duration")).alias("total_time_min"),
        minutes(F.col("_t.transitTime")).alias("iv_time_min"), minutes(F.col("_t.walkTime")).alias("walk_time_min"),
        minutes(F.col("_t.waitingTime")).alias("wait_time_min"), F.coalesce("_t.transfers", F.lit(0)).alias("transfers"),
        kilometres(metres).alias("distance_km"), fare["fare"].alias("pt_fare_proxy"),
        ok.cast("int").alias("accessible_flag"), "error_code", F.when(ok, fare["fare_status"]).alias("fare_status"),
    )


def parse_drive(docs: DataFrame) -> DataFrame:
    """Car skims from route summaries, with the outcome status."""
    rows = _parsed(with_route_keys(docs, DRIVE_NAME), DRIVE_SCHEMA)
    corrupt = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull()
    code = F.coalesce(F.col("_d.status"), F.lit("UNKNOWN"))
    status = (
        F.when(corrupt, "BAD_JSON")
        .when(F.col("is_error"), F.concat(F.lit("HTTP_"), code))
        .when(F.col("_d.status") != "0", F.concat(F.lit("ROUTING_ERROR_"), code))
        .when(F.col("_d.status").isNull(), "ROUTING_ERROR_UNKNOWN")
        .when(F.col("_d.route_summary").isNull(), "NO_ROUTE_SUMMARY").otherwise("OK")
    )
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "OK"
    detail = (
        F.when(F.col("status").startswith("HTTP_"), "HTTP_ERROR")
        .when(F.col("status").startswith("ROUTING_ERROR"), F.concat(F.lit("ROUTING_ERROR: "), F.coalesce("_d.status_message", F.lit("Unknown routing error"))))
        .when(F.col("status") == "NO_ROUTE_SUMMARY", "INVALID_JSON").when(F.col("status") == "BAD_JSON", "INVALID_JSON")
    )
    return rows.select(
        "origin_id", "dest_id", F.lit("drive").alias("mode"),
        minutes(F.when(ok, F.col("_d.route_summary.total_time"))).alias("travel_time_min"),
        kilometres(F.when(ok, F.col("_d.route_summary.total_distance"))).alias("distance_km"),
        ok.cast("int").alias("accessible_flag"), "status", detail.alias("error_type"),
    )

"""Travel-cost tables from route rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions.costs import parking_fee, road_charge, vehicle_cost, zone_level
from tripweave.operators.aggregates import counts_by, status_report
from tripweave.operators.lookup import left_lookup


def name_pairs(skims: DataFrame, origins: DataFrame, dests: DataFrame) -> DataFrame:
    """Add origin and destination names."""
    out = left_lookup(skims, origins.withColumnRenamed("name", "origin_name"), {"origin_id": "origin_id"}, ["origin_name"])
    return left_lookup(out, dests.withColumnRenamed("name", "dest_name"), {"dest_id": "poi_id"}, ["dest_name"])


def with_cost_proxy(skims: DataFrame, origin_flags: DataFrame, dest_flags: DataFrame) -> DataFrame:
    """Distance cost, road charge, parking and total for car skims; zones without flags are outer."""
    o = origin_flags.select("origin_id", F.col("cbd_flag").alias("_oc"), F.col("central_area_flag").alias("_oa"))
    d = dest_flags.select("dest_id", F.col("cbd_flag").alias("_dc"), F.col("central_area_flag").alias("_da"))
    df = skims.join(o, "origin_id", "left").join(d, "dest_id", "left")
    df = df.withColumn("origin_zone", zone_level(F.col("_oc"), F.col("_oa"))).withColumn("dest_zone", zone_level(F.col("_dc"), F.col("_da")))
    df = (
        df.withColumn("distance_cost", vehicle_cost(F.col("distance_km")))
        .withColumn("erp_proxy", road_charge(F.col("origin_zone"), F.col("dest_zone")))
        .withColumn("park_fee_proxy", parking_fee(F.col("dest_zone")))
    )
    return df.withColumn("total_cost_proxy", F.col("distance_cost") + F.col("erp_proxy") + F.col("park_fee_proxy")).drop("_oc", "_oa", "_dc", "_da")


def transit_report(skims: DataFrame) -> dict[str, DataFrame]:
    """Status, fare, combined and overall counts of public-transport rows."""
    overall = status_report(
        skims, "error_code",
        {"Successful Routes (OK)": "OK", "HTTP 404 Errors": "HTTP_404", "No Itinerary Found": "NO_ITINERARY"},
        {"Exceptions": "BAD_JSON"}, "Other Error: ",
    )
    fares = skims.agg(
        F.count_if(F.col("fare_status") == "INFO_UNAVAILABLE").alias("u"), F.count_if(F.col("fare_status") == "OK").alias("k")
    ).select(F.inline(F.array(
        F.struct(F.lit("Fare Info Unavailable").alias("category"), F.col("u").alias("count")),
        F.struct(F.lit("Fare Info Available").alias("category"), F.col("k").alias("count")),
    )))
    return {
        "status": counts_by(skims, ["error_code"]),
        "fare": counts_by(skims.filter("error_code = 'OK'"), ["fare_status"]),
        "combined": counts_by(skims, ["error_code", "fare_status"]),
        "overall": overall.unionByName(fares),
    }


def drive_report(skims: DataFrame) -> dict[str, DataFrame]:
    """Status counts of car rows."""
    return {
        "status": counts_by(skims, ["status"]),
        "overall": status_report(
            skims, "status", {"Successful Routes (OK)": "OK", "HTTP 404 Errors": "HTTP_404", "HTTP 400 Errors": "HTTP_400"},
            {"Routing Errors": "ROUTING_ERROR", "Exceptions": "BAD_JSON"}, "Other Status: ",
        ),
    }

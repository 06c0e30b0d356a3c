"""Origin table: population, allocated households, income statistics, car proxies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.numeric import bucket_value, piecewise_interpolate
from tripweave.functions.text import clean_name, norm_key, parse_number
from tripweave.operators.allocation import allocate, grouped_mean, grouped_median
from tripweave.operators.columns import normalise_headers, require_columns, select_existing
from tripweave.operators.filters import drop_equal_text
from tripweave.operators.linear import PrincipalComponents
from tripweave.operators.lookup import fallback_key
from tripweave.operators.scaling import min_max

ORIGIN_TABLE = [
    "subzone_id", "subzone_name", "planning_area", "area_sqm", "centroid_x", "centroid_y", "pop_total",
    "population_density", "Mean_Monthly_Income", "Median_Monthly_Income", "Median_Monthly_Income_Percentile",
    "Interpolated_Expenditure", "VehicleExp_p", "Interpolated_VehicleExp_p", "car_proxy_1", "car_proxy_2",
    "PCA_Car_Proxy", "PCA_Car_Proxy_01", "hh_1p", "hh_2p", "hh_3p", "hh_4p", "hh_5p", "hh_6p", "hh_7p", "hh_8p_plus",
    "avg_hh_size",
]


def clean_population(raw: DataFrame) -> DataFrame:
    """Population rows without totals or blanks; ``-`` is 0."""
    df = require_columns(normalise_headers(raw), ["planning_area", "subzone", "pop_total"])
    df = drop_equal_text(df, "subzone", "total").dropna("all")
    count = parse_number(F.col("pop_total"), dash_is_zero=True, bad=0).cast("bigint")
    return df.withColumn("pop_total", count).withColumn("planning_area", clean_name(F.col("planning_area")))


def allocate_table(population: DataFrame, table: DataFrame, values: Sequence[str]) -> DataFrame:
    """Area-level ``values`` split over subzones by population; areas not listed share 'Others'."""
    first = table.columns[0]
    side = table.select(clean_name(F.col(f"`{first}`")).alias("_area"), *[parse_number(F.col(f"`{v}`").cast("string"), bad=0).alias(v) for v in values])
    keyed = fallback_key(population, "planning_area", side, "_area")
    joined = keyed.join(side, F.col("match_key") == F.col("_area"))
    out = allocate(joined, "match_key", "pop_total", values)
    return out.select("planning_area", "subzone", *[f"`{v}`" for v in values])


def income_statistics(counts: DataFrame, keys: Sequence[str] = ("planning_area", "subzone")) -> DataFrame:
    """Grouped mean (earners only) and grouped median of the income classes."""
    classes = [(i, *c) for i, c in enumerate(K.INCOME_CLASSES)]
    present = [c for c in classes if c[1] in counts.columns]
    earners = {f"`{label}`": mid for _, label, _, mid, _ in present if label != "No Employed Person"}
    means = counts.withColumn("Mean_Monthly_Income", grouped_mean(earners))
    last = K.INCOME_CLASSES[-1][0]
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("class_id"), F.lit(float(low)).alias("lower"), F.lit(float(width)).alias("width"),
            F.coalesce(F.col(f"`{label}`"), F.lit(0.0)).cast("double").alias("n"), F.lit(label == last).alias("is_open"),
        )
        for i, label, low, _, width in present
    ])
    long = counts.select(*keys, F.inline(cells))
    medians = grouped_median(long, list(keys), "class_id", "lower", "width", "n", "is_open")
    return means.join(
        medians.withColumnsRenamed({"median": "Median_Monthly_Income"}), list(keys), "left"
    )


def car_proxies(df: DataFrame, income: str = "Median_Monthly_Income") -> DataFrame:
    """Income percentile, expenditure, ownership and vehicle-expenditure proxies.

    Income 0 or missing gives NULL throughout.
    """
    x = F.when(F.col(income) != 0, F.col(income).cast("double"))
    df = df.withColumn("Median_Monthly_Income_Percentile", piecewise_interpolate(x, K.INCOME_KNOTS, K.PERCENTILE_KNOTS))
    df = df.withColumn("Interpolated_Expenditure", piecewise_interpolate(x, K.INCOME_KNOTS, K.EXPENDITURE_KNOTS))
    spend, rank = F.col("Interpolated_Expenditure"), F.col("Median_Monthly_Income_Percentile")
    return df.withColumns({
        "Ownership": bucket_value(spend, K.OWNERSHIP_EDGES, K.OWNERSHIP_VALUES),
        "car_proxy_1": piecewise_interpolate(spend, K.OWNERSHIP_MIDPOINTS, K.OWNERSHIP_VALUES),
        "VehicleExp_p": bucket_value(rank, K.VEHICLE_EDGES, K.VEHICLE_VALUES),
        "car_proxy_2": piecewise_interpolate(rank, K.VEHICLE_EDGES, [*K.VEHICLE_VALUES, K.VEHICLE_VALUES[-1]]),
    })


def combined_car_proxy(df: DataFrame, cols: Sequence[str] = ("car_proxy_1", "car_proxy_2")) -> DataFrame:
    """First principal component of the two proxies, and its min-max scaled copy."""
    scored = PrincipalComponents(df, cols, "zscore").scores(df, 1, "_pc").withColumnRenamed("_pc1", "PCA_Car_Proxy")
    return min_max(scored, "PCA_Car_Proxy", "PCA_Car_Proxy_01", constant=0.5)


def origin_table(zones: DataFrame, population: DataFrame, car: DataFrame, households: DataFrame) -> DataFrame:
    """One row per zone with everything joined on normalised names, fixed column order.

    ``car`` and ``households`` must hold one row per planning area.
    """
    pop = population.select(norm_key(F.col("subzone")).alias("subzone_name"), norm_key(F.col("planning_area")).alias("planning_area"), "pop_total")
    z = zones.withColumn("subzone_name", norm_key(F.col("subzone_name"))).join(pop, "subzone_name", "left")
    z = z.withColumn("population_density", F.try_divide("pop_total", "area_sqm"))
    for side in (car, households):
        z = z.join(side.withColumn("planning_area", norm_key(F.col("planning_area"))), "planning_area", "left")
    return select_existing(z, ORIGIN_TABLE)

"""Interpolation, codes, flags, travel costs, angles and projection."""

import math

from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions import costs, geo, numeric
from tripweave.operators.scaling import min_max
from tripweave.plans.skims import with_cost_proxy
from tripweave.queries.registry import query
from tripweave.tables import table


def knots_sql(x: str, xp, fp) -> str:
    """The same piecewise line as SQL text."""
    whens = "".join(
        f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * {repr((y1 - y0) / (x1 - x0))}::DOUBLE" for x0, x1, y0, y1 in zip(xp, xp[1:], fp, fp[1:])
    )
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {xp[0]} THEN {fp[0]}{whens} ELSE {fp[-1]} END::DOUBLE"


def steps_sql(x: str, edges, values) -> str:
    """The same step function as SQL text."""
    whens = "".join(f" WHEN {x} < {e} THEN {v}" for e, v in zip(edges[1:], values[:-1]))
    return f"CASE WHEN {x} IS NULL THEN NULL{whens} ELSE {values[-1]} END::DOUBLE"


RISING = [max(K.OWNERSHIP_VALUES[: i + 1]) for i in range(len(K.OWNERSHIP_VALUES))]


@query("F13", f"""
SELECT o_orderkey, round({knots_sql('x', K.INCOME_KNOTS, K.PERCENTILE_KNOTS)}, 6) AS percentile,
  round({knots_sql('x', K.INCOME_KNOTS, K.EXPENDITURE_KNOTS)}, 6) AS expenditure,
  round({knots_sql('x', K.OWNERSHIP_MIDPOINTS, RISING)}, 6) AS ownership
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 17 - 500 END AS x FROM orders)
""")
def piecewise_interpolation(spark, d):
    x = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 17 - 500)
    o = table(spark, d, "orders", "o_orderkey", x.alias("x"))
    return o.select(
        "o_orderkey",
        F.round(numeric.piecewise_interpolate(F.col("x"), K.INCOME_KNOTS, K.PERCENTILE_KNOTS), 6).alias("percentile"),
        F.round(numeric.piecewise_interpolate(F.col("x"), K.INCOME_KNOTS, K.EXPENDITURE_KNOTS), 6).alias("expenditure"),
        F.round(numeric.piecewise_interpolate(F.col("x"), K.OWNERSHIP_MIDPOINTS, K.OWNERSHIP_VALUES, monotone=True), 6).alias("ownership"),
    )


@query("F14", f"""
SELECT c_custkey, {steps_sql('x', K.OWNERSHIP_EDGES, K.OWNERSHIP_VALUES[:11])} AS ownership
FROM (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_acctbal * 2 END AS x FROM customer)
""")
def bucket_values(spark, d):
    x = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") * 2)
    c = table(spark, d, "customer", "c_custkey", x.alias("x"))
    return c.select("c_custkey", numeric.bucket_value(F.col("x"), K.OWNERSHIP_EDGES, K.OWNERSHIP_VALUES).alias("ownership"))


MIDPOINTS_SQL = " ".join(f"WHEN {k} THEN {v}" for k, v in K.INCOME_CODE_MIDPOINTS.items())


@query("F15 F16 F17 F19", f"""
SELECT p_partkey, CASE p_size % 18 {MIDPOINTS_SQL} END::INTEGER AS income_mid,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 1 ELSE 0 END AS basic,
  greatest(p_size % 6 - 1, 0)::INTEGER AS days, (6 - (p_size % 5 + 1))::INTEGER AS reversed,
  CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS d_med, CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END AS d_lrg
FROM part
""")
def coded_answers(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", "p_type")
    size = F.col("p_size")
    dummies = numeric.level_dummies(size % 3)
    return p.select(
        "p_partkey", numeric.code_map(size % 18, K.INCOME_CODE_MIDPOINTS).alias("income_mid"),
        numeric.flag_in(F.col("p_type"), ["ECONOMY", "SMALL"]).alias("basic"), F.greatest(size % 6 - 1, F.lit(0)).alias("days"),
        numeric.reverse_score(size % 5 + 1).alias("reversed"), dummies["D_med"].alias("d_med"), dummies["D_lrg"].alias("d_lrg"),
    )


DELTAS_SQL = " ".join(f"WHEN {k} THEN {v}" for k, v in K.LEVEL_DELTAS["pt_time"].items())


@query("F18", f"""
SELECT o_orderkey, round_even(CASE WHEN o_orderkey % 7 < 6 THEN o_totalprice / 1000 + CASE o_orderkey % 7 {DELTAS_SQL} ELSE 0 END END, 2) AS minutes
FROM orders
""")
def pivoted_levels(spark, d):
    level = F.when(F.col("o_orderkey") % 7 < 6, F.col("o_orderkey") % 7)
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", level.alias("level"))
    return o.select("o_orderkey", numeric.pivot_level(F.col("o_totalprice") / 1000, F.col("level"), K.LEVEL_DELTAS["pt_time"]).alias("minutes"))


ZONE_SQL = "CASE WHEN {0} % 5 = 0 THEN 2 WHEN {0} % 3 = 0 THEN 1 ELSE 0 END"


@query("F20 F21 F22 F23 J2", f"""
WITH z AS (
  SELECT o_orderkey, l_linenumber, l_quantity AS distance_km,
    {ZONE_SQL.format('c_nationkey')} AS origin_zone, {ZONE_SQL.format('s_nationkey')} AS dest_zone
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT *, CASE WHEN origin_zone = 0 AND dest_zone = 1 THEN 2.0 WHEN origin_zone = 0 AND dest_zone = 2 THEN 3.0
    WHEN origin_zone = 1 AND dest_zone = 2 THEN 1.5 WHEN origin_zone = 2 AND dest_zone = 2 THEN 1.0
    WHEN origin_zone = 1 AND dest_zone = 1 THEN 0.5 ELSE 0 END AS erp,
    CASE dest_zone WHEN 2 THEN 6 WHEN 1 THEN 4 ELSE 1.5 END AS park FROM z)
SELECT origin_zone, dest_zone, count(*) AS n, round(sum(distance_km * 0.25), 4) AS distance_cost,
  round(sum(erp)::DOUBLE, 4) AS erp_proxy, round(sum(park)::DOUBLE, 4) AS park_fee_proxy,
  round(sum(distance_km * 0.25 + erp + park)::DOUBLE, 4) AS total_cost_proxy
FROM c GROUP BY 1, 2
""")
def vehicle_cost_matrix(spark, d):
    customers = table(spark, d, "customer", "c_custkey", F.col("c_nationkey").alias("origin_id"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    trips = (
        table(spark, d, "lineitem", "l_orderkey", "l_suppkey", F.col("l_quantity").alias("distance_km"))
        .join(orders.select("o_orderkey", "origin_id"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "supplier", "s_suppkey", F.col("s_nationkey").alias("dest_id")), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("origin_id", "dest_id", "distance_km")
    )
    key = F.col("n_nationkey")
    flags = table(spark, d, "nation", "n_nationkey").select(
        key.alias("origin_id"), (key % 5 == 0).cast("int").alias("cbd_flag"), (key % 3 == 0).cast("int").alias("central_area_flag")
    )
    priced = with_cost_proxy(trips, flags, flags.withColumnRenamed("origin_id", "dest_id"))
    parts = ["distance_cost", "erp_proxy", "park_fee_proxy", "total_cost_proxy"]
    return priced.groupBy("origin_zone", "dest_zone").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in parts]
    )


@query("F24 F25 F26", """
SELECT l_suppkey, round(avg(l_quantity + l_extendedprice / 1000 / 0.20 + l_linenumber * 5.0), 6) AS gtc_od,
  round(avg(l_quantity + l_extendedprice / 1000 / 0.20), 6) AS gtc_car,
  round(avg(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity + l_linenumber + (l_extendedprice / 1000 + l_tax) / 0.20 + 5.0 END), 6) AS gtc_survey
FROM lineitem GROUP BY 1
""")
def generalised_costs(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_returnflag")
    fare = F.col("l_extendedprice") / 1000
    survey = costs.survey_cost(
        F.col("l_quantity"), F.col("l_linenumber"), fare, F.col("l_tax"), F.lit(1.0), F.col("l_returnflag") == "N"
    )
    return li.groupBy("l_suppkey").agg(
        F.round(F.avg(costs.transit_cost(F.col("l_quantity"), fare, F.col("l_linenumber"))), 6).alias("gtc_od"),
        F.round(F.avg(costs.car_cost(F.col("l_quantity"), fare)), 6).alias("gtc_car"),
        F.round(F.avg(survey), 6).alias("gtc_survey"),
    )


@query("F27 F28 F30", """
WITH p AS (SELECT vec_id, 1.3 + embedding[1]::DOUBLE / 10 AS lat, 103.8 + embedding[2]::DOUBLE / 10 AS lon,
    180 + 400 * embedding[3]::DOUBLE AS h1, 180 + 400 * embedding[4]::DOUBLE AS h2 FROM embeddings)
SELECT vec_id,
  round((degrees(atan2(sin(radians(103.85 - lon)) * cos(radians(1.35)),
    cos(radians(lat)) * sin(radians(1.35)) - sin(radians(lat)) * cos(radians(1.35)) * cos(radians(103.85 - lon)))) + 360) % 360, 6) AS heading,
  round(CASE WHEN h1 >= 0 AND h2 >= 0 THEN least(abs(h1 - h2), 360 - abs(h1 - h2)) ELSE 0 END, 6) AS gap,
  round(lon - 50 / 111000, 8) AS west, round(lat + 50 / 111000, 8) AS north
FROM p
""")
def bearings_and_boxes(spark, d):
    e = F.col("embedding")

    def dim(i):
        return e[i].cast("double")

    p = table(spark, d, "embeddings").select(
        "vec_id", (F.lit(1.3) + dim(0) / 10).alias("lat"), (F.lit(103.8) + dim(1) / 10).alias("lon"),
        (180 + 400 * dim(2)).alias("h1"), (180 + 400 * dim(3)).alias("h2"),
    )
    box = geo.degree_box(F.col("lat"), F.col("lon"), 50)
    return p.select(
        "vec_id", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(1.35), F.lit(103.85)), 6).alias("heading"),
        F.round(geo.angle_gap(F.col("h1"), F.col("h2")), 6).alias("gap"),
        F.round(box["west"], 8).alias("west"), F.round(box["north"], 8).alias("north"),
    )


def meridian_sql(phi: str) -> str:
    e2 = 2 * geo.FLATTENING - geo.FLATTENING**2
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    m2 = 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128)
    m4 = 15 / 256 * (e2**2 + 3 * e2**3 / 4)
    m6 = 35 * e2**3 / 3072
    return f"6378137.0::DOUBLE * ({m0!r}::DOUBLE * {phi} - {m2!r}::DOUBLE * sin(2 * {phi}) + {m4!r}::DOUBLE * sin(4 * {phi}) - {m6!r}::DOUBLE * sin(6 * {phi}))"


_E2 = 2 * geo.FLATTENING - geo.FLATTENING**2
_EP2 = _E2 / (1 - _E2)


@query("F29", f"""
WITH p AS (SELECT vec_id, 1.35::DOUBLE + embedding[1]::DOUBLE / 10 AS lat, 103.8::DOUBLE + embedding[2]::DOUBLE / 10 AS lon FROM embeddings),
q AS (SELECT vec_id, lat, lon, radians(lat) AS phi, tan(radians(lat)) AS tn, pow(tan(radians(lat)), 2) AS t, {_EP2!r}::DOUBLE * pow(cos(radians(lat)), 2) AS c,
    6378137.0::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * pow(sin(radians(lat)), 2)) AS nu,
    (radians(lon) - {math.radians(geo.ORIGIN_LON)!r}::DOUBLE) * cos(radians(lat)) AS a FROM p)
SELECT vec_id,
  round(28001.642 + nu * (a + pow(a, 3) * (1 - t + c) / 6 + pow(a, 5) * (5 - 18 * t + t * t + 72 * c - 58 * {_EP2!r}::DOUBLE) / 120), 4) AS x_m,
  round(38744.572 + {meridian_sql('phi')} - {geo._ARC_ORIGIN!r}::DOUBLE
    + nu * tn * (a * a / 2 + pow(a, 4) * (5 - t + 9 * c + 4 * c * c) / 24 + pow(a, 6) * (61 - 58 * t + t * t + 600 * c - 330 * {_EP2!r}::DOUBLE) / 720), 4) AS y_m,
  round(lat, 6) AS lat_back, round(lon, 6) AS lon_back
FROM q
""")
def metric_projection(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(
        "vec_id", (F.lit(1.35) + e[0].cast("double") / 10).alias("lat"), (F.lit(103.8) + e[1].cast("double") / 10).alias("lon")
    )
    m = p.withColumn("m", geo.to_metric(F.col("lat"), F.col("lon")))
    back = m.withColumn("w", geo.to_wgs84(F.col("m.x_m"), F.col("m.y_m")))
    return back.select(
        "vec_id", F.round("m.x_m", 4).alias("x_m"), F.round("m.y_m", 4).alias("y_m"),
        F.round("w.lat", 6).alias("lat_back"), F.round("w.lon", 6).alias("lon_back"),
    )


@query("F31 F32", """
SELECT l_orderkey, l_linenumber, l_shipdate,
  CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 0 ELSE l_extendedprice END::DOUBLE AS fare,
  CASE WHEN l_returnflag = 'N' THEN 'NULL' WHEN l_linenumber = 1 THEN 'INFO_UNAVAILABLE' WHEN l_linenumber = 2 THEN 'PARSE_ERROR_free' ELSE 'OK' END AS fare_status,
  round(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END / 60, 8) AS minutes,
  round(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END / 1000, 8) AS km
FROM lineitem
""")
def fares_and_units(spark, d):
    fare = (
        F.when(F.col("l_returnflag") == "N", None).when(F.col("l_linenumber") == 1, "Info Unavailable")
        .when(F.col("l_linenumber") == 2, "free").otherwise(F.col("l_extendedprice").cast("decimal(20,2)").cast("string"))
    )
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus", fare.alias("f"))
    parsed = costs.fare_amount(F.col("f"))
    known = F.col("l_linestatus") == "O"
    return li.select(
        "l_orderkey", "l_linenumber", "l_shipdate", parsed["fare"].alias("fare"), parsed["fare_status"].alias("fare_status"),
        F.round(costs.minutes(F.when(known, F.col("l_quantity"))), 8).alias("minutes"),
        F.round(costs.kilometres(F.when(known, F.col("l_extendedprice"))), 8).alias("km"),
    )


@query("F34 W7", """
WITH g AS (SELECT l_orderkey, ln(1 + l_quantity) AS v FROM lineitem),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM g)
SELECT l_orderkey, round(sum((v - lo) / (hi - lo)), 6) AS activity FROM g, s GROUP BY 1
""")
def log_scaled_counts(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", F.log1p("l_quantity").alias("v"))
    scaled = min_max(li, "v", "activity", constant=0.0)
    return scaled.groupBy("l_orderkey").agg(F.round(F.sum("activity"), 6).alias("activity"))


@query("F35", """
WITH f AS (SELECT p_partkey, p_retailprice AS x, list_filter([
    CASE WHEN p_retailprice < 910 THEN 'below minimum' WHEN p_retailprice < 950 THEN 'below typical' END,
    CASE WHEN p_retailprice > 1050 THEN 'above maximum' WHEN p_retailprice > 1000 THEN 'above typical' END,
    CASE WHEN p_retailprice < 905 THEN 'low outlier' END, CASE WHEN p_retailprice > 1090 THEN 'high outlier' END], lambda v: v IS NOT NULL) AS marks FROM part)
SELECT p_partkey, coalesce(array_to_string(marks, ' | '), '') AS flags,
  CASE WHEN x < 910 OR x > 1050 THEN 3 WHEN x < 950 OR x > 1000 THEN 2 END AS max_severity, len(marks)::INTEGER AS flag_count
FROM f
""")
def threshold_flags(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice")
    limits = [F.lit(float(v)) for v in (910, 950, 1000, 1050)]
    flagged = p.withColumn("f", numeric.flag_range(F.col("p_retailprice"), limits, [F.lit(905.0), F.lit(1090.0)]))
    return flagged.select("p_partkey", "f.flags", "f.max_severity", "f.flag_count")


@query("F38 F39", """
SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.10 THEN '.' ELSE '' END AS sig,
  CASE WHEN p > 0.90 THEN 'positive' WHEN p < 0.10 THEN 'negative' ELSE 'uncertain' END AS verdict
FROM (SELECT event_id, value / 500 AS p FROM events)
""")
def significance_labels(spark, d):
    p = table(spark, d, "events", "event_id", (F.col("value") / 500).alias("p"))
    return p.select("event_id", numeric.significance(F.col("p")).alias("sig"), numeric.sign_verdict(F.col("p")).alias("verdict"))

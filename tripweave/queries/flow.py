"""Origin-destination flows: nations as origins, suppliers as destinations."""

from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.plans import od_flow as flow
from tripweave.queries.registry import query
from tripweave.session import cut_lineage
from tripweave.tables import table

OD_SQL = """
WITH od AS (SELECT c_nationkey AS origin_id, l_suppkey AS poi_id, avg(l_extendedprice) / 1000 AS gtc, count(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
size AS (SELECT l_suppkey AS poi_id, sum(l_quantity) AS scale_m2, count(*) AS rating_count FROM lineitem GROUP BY 1),
cut AS (SELECT quantile_cont(scale_m2, 1/3) AS c1, quantile_cont(scale_m2, 2/3) AS c2 FROM size),
dest AS (SELECT poi_id, scale_m2, rating_count, CASE WHEN scale_m2 < c1 THEN 0 WHEN scale_m2 < c2 THEN 1 ELSE 2 END AS scale_cat FROM size, cut),
origin AS (SELECT c_nationkey AS origin_id, count(*) * CASE WHEN c_nationkey % 5 = 0 THEN 0.30 ELSE 0.20 END::DOUBLE AS T_o_base FROM customer GROUP BY 1),
v AS (SELECT od.*, dest.scale_cat, T_o_base, exp(-0.0074 * gtc + CASE scale_cat WHEN 1 THEN 0.4485 WHEN 2 THEN 0.6691 ELSE 0 END) AS e, exp(-0.0074 * gtc) AS ep
  FROM od JOIN dest USING (poi_id) JOIN origin USING (origin_id)),
s AS (SELECT *, sum(e) OVER (PARTITION BY origin_id) + 1 AS den, sum(ep) OVER (PARTITION BY origin_id) + 1 AS denp FROM v),
p AS (SELECT *, e / den AS P_od, ep / denp AS P_plain, 1 / den AS p_outside, (den - 1) / den AS coverage, T_o_base * e / den AS flow_base, T_o_base * ep / denp AS flow_plain FROM s)
"""


def _trips(spark, d):
    """Lines with their customer's nation. Orders meet customers first, so lines shuffle once."""
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey")
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice").join(
        orders.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def od_pairs(spark, d):
    """Mean cost per nation and supplier."""
    return _trips(spark, d).groupBy(F.col("c_nationkey").alias("origin_id"), F.col("l_suppkey").alias("poi_id")).agg(
        (F.avg("l_extendedprice") / 1000).alias("gtc"), F.count(F.lit(1)).alias("n_lines")
    )


def destinations(spark, d):
    """Suppliers with a size measure, size class and observed count."""
    size = table(spark, d, "lineitem", "l_suppkey", "l_quantity").groupBy(F.col("l_suppkey").alias("poi_id")).agg(
        F.sum("l_quantity").alias("scale_m2"), F.count(F.lit(1)).alias("rating_count")
    )
    return flow.tertile(cut_lineage(size), "scale_m2", "scale_cat")


def productions(spark, d):
    """Trips per nation."""
    c = table(spark, d, "customer", F.col("c_nationkey").alias("origin_id")).groupBy("origin_id").agg(F.count(F.lit(1)).alias("pop_total"))
    c = c.withColumns({"cbd_flag": (F.col("origin_id") % 5 == 0).cast("int"), "PCA_Car_Proxy_01": F.col("origin_id") / 25})
    return flow.trip_production(c)


def flow_table(spark, d):
    """OD rows with utility, share and flow."""
    od = cut_lineage(od_pairs(spark, d)).join(destinations(spark, d).select("poi_id", "D_med", "D_lrg"), "poi_id")
    od = od.join(productions(spark, d).select("origin_id", "T_o_base"), "origin_id")
    return flow.flows(flow.shares(flow.utilities(od)))


@query("O1", """
SELECT c_nationkey AS origin_id, round(count(*) * CASE WHEN c_nationkey % 5 = 0 THEN 0.30 ELSE 0.20 END::DOUBLE, 6) AS T_o_base,
  round(count(*) * CASE WHEN c_nationkey % 5 = 0 THEN 0.30 ELSE 0.20 END::DOUBLE * exp(0.3 * c_nationkey / 25), 6) AS T_o FROM customer GROUP BY 1
""")
def trip_production(spark, d):
    return productions(spark, d).select("origin_id", F.round("T_o_base", 6).alias("T_o_base"), F.round("T_o", 6).alias("T_o"))


@query("O2", """
SELECT p_partkey, CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN p_size ELSE p_retailprice END::DOUBLE AS scale_m2, CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN 'gfa' ELSE 'footprint' END AS scale_source,
  CASE WHEN x < c1 THEN 0 WHEN x < c2 THEN 1 ELSE 2 END AS scale_cat
FROM (SELECT *, CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN p_size ELSE p_retailprice END AS x FROM part),
  (SELECT quantile_cont(x, 1/3) AS c1, quantile_cont(x, 2/3) AS c2 FROM (SELECT CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN p_size ELSE p_retailprice END AS x FROM part))
""")
def size_measure(spark, d):
    gfa = F.when(F.col("p_type") != "PROMO", F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0)).cast("double")
    p = table(spark, d, "part", "p_partkey", "p_size", "p_type", F.col("p_retailprice").alias("footprint_area")).withColumn("gfa", gfa)
    return flow.size_classes(p).select("p_partkey", "scale_m2", "scale_source", "scale_cat")


@query("O3 O4", """
SELECT p_partkey, CASE WHEN p_size < c1 THEN 0 WHEN p_size < c2 THEN 1 ELSE 2 END AS scale_cat, (p_size < c1)::INTEGER AS D_sml,
  (p_size >= c1 AND p_size < c2)::INTEGER AS D_med, (p_size >= c2)::INTEGER AS D_lrg,
  CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 2 WHEN 'PROMO' THEN 3 ELSE 5 END AS cat_fe, (p_type = 'LARGE')::INTEGER AS cat_fe_2
FROM part, (SELECT quantile_cont(p_size, 1/3) AS c1, quantile_cont(p_size, 2/3) AS c2 FROM part)
""")
def size_and_category_codes(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", F.lower("p_type").alias("subtype"))
    coded = flow.category_codes(flow.tertile(p, "p_size", "scale_cat"), {"small": 0, "large": 2, "promo": 3})
    return coded.select("p_partkey", "scale_cat", "D_sml", "D_med", "D_lrg", "cat_fe", "cat_fe_2")


@query("O5 W5 W6 F24", OD_SQL + """
SELECT origin_id, poi_id, round(P_od, 10) AS P_od, round(P_plain, 10) AS P_plain, round(p_outside, 10) AS p_outside, round(coverage, 10) AS coverage FROM p
""")
def choice_probabilities(spark, d):
    return flow_table(spark, d).select("origin_id", "poi_id", *[F.round(c, 10).alias(c) for c in ("P_od", "P_plain", "p_outside", "coverage")])


@query("O6 A6", OD_SQL + """
SELECT poi_id, round(sum(flow_base), 6) AS mu_base, round(sum(flow_plain), 6) AS mu_plain_base FROM p GROUP BY 1
""")
def destination_flow_totals(spark, d):
    totals = flow_table(spark, d).groupBy("poi_id").agg(F.sum("flow_base").alias("mu_base"), F.sum("flow_plain").alias("mu_plain_base"))
    return totals.select("poi_id", F.round("mu_base", 6).alias("mu_base"), F.round("mu_plain_base", 6).alias("mu_plain_base"))


@query("O7 O10 A10", OD_SQL + """,
t AS (SELECT poi_id, sum(flow_base) AS mu, sum(flow_plain) AS mup, sum(greatest(flow_base, 1e-9) * coverage) / sum(greatest(flow_base, 1e-9)) AS cov FROM p GROUP BY 1),
f AS (SELECT sum(rating_count) / sum(mu) AS k FROM t JOIN dest USING (poi_id))
SELECT poi_id, rating_count, scale_cat, round(mu * k, 4) AS mu_j, round(mup * k, 4) AS mu_j_no_scale, round(cov, 8) AS mean_coverage FROM t JOIN dest USING (poi_id), f
""")
def calibration_table(spark, d):
    table_ = flow.calibration(destinations(spark, d), cut_lineage(flow_table(spark, d)))
    return table_.select("poi_id", "rating_count", "scale_cat", F.round("mu_j", 4).alias("mu_j"), F.round("mu_j_no_scale", 4).alias("mu_j_no_scale"), F.round("mean_coverage", 8).alias("mean_coverage"))


@query("O8 M5", OD_SQL + """,
m AS (SELECT origin_id, avg(gtc) AS mean_gtc FROM od GROUP BY 1),
l AS (SELECT regr_slope(origin_id / 25, mean_gtc) AS a, regr_intercept(origin_id / 25, mean_gtc) AS b FROM m)
SELECT origin_id, round(mean_gtc, 6) AS mean_gtc, round(origin_id / 25 - (a * mean_gtc + b), 6) AS PCA_Car_resid FROM m, l
""")
def car_residuals(spark, d):
    out = flow.car_residual(productions(spark, d), cut_lineage(od_pairs(spark, d)))
    return out.select("origin_id", F.round("mean_gtc", 6).alias("mean_gtc"), F.round("PCA_Car_resid", 6).alias("PCA_Car_resid"))


@query("O10 J4", OD_SQL + """
SELECT origin_id, poi_id, round(flow_base, 6) AS flow_base, scale_cat AS flag_d, (origin_id % 5 = 0)::INTEGER AS flag_o FROM p
""")
def long_calibration_table(spark, d):
    from tripweave.operators.lookup import inner_suffixed

    od = flow_table(spark, d).select("origin_id", "poi_id", "flow_base")
    left = od.join(destinations(spark, d).select("poi_id", F.col("scale_cat").alias("flag")), "poi_id")
    right = productions(spark, d).select("origin_id", F.col("cbd_flag").alias("flag"))
    return inner_suffixed(left, right, ["origin_id"], ("_d", "_o")).select("origin_id", "poi_id", F.round("flow_base", 6).alias("flow_base"), "flag_d", "flag_o")


@query("O11", OD_SQL + """,
x AS (SELECT origin_id, sum(P_od) + max(p_outside) AS a, sum(P_plain) + 1 / max(denp) AS b FROM p GROUP BY 1),
m AS (SELECT poi_id, sum(flow_base) AS mu, sum(flow_plain) AS mup FROM p GROUP BY 1),
k AS (SELECT sum(rating_count) / sum(mu) AS k FROM m JOIN dest USING (poi_id))
SELECT 'shares plus outside = 1' AS rule, count(*) FILTER (abs(a - 1) > 1e-6) AS count FROM x
UNION ALL SELECT 'plain shares plus outside = 1', count(*) FILTER (abs(b - 1) > 1e-6) FROM x
UNION ALL SELECT 'negative prediction', count(*) FILTER (mup * k < 0) FROM m, k
UNION ALL SELECT 'scale factor not finite', count(*) FILTER (k IS NULL OR NOT isfinite(k)) FROM m, k
""")
def flow_invariants(spark, d):
    od = cut_lineage(flow_table(spark, d))
    return flow.invariants(od, flow.calibration(destinations(spark, d), od))


@query("A37 M2 J8", OD_SQL + """,
d AS (SELECT poi_id, scale_m2, CASE WHEN poi_id % 11 = 0 THEN 0 ELSE rating_count END AS rc, CASE WHEN poi_id % 9 <> 0 THEN 1 + (poi_id * 7 % 41)::DOUBLE / 10 END AS rating,
  (poi_id % 7 <> 0 AND poi_id % 11 <> 0) AS el FROM dest),
q AS (SELECT *, quantile_cont(rc, 0.99) OVER () AS high, count(*) OVER () AS n FROM d),
h AS (SELECT * FROM p WHERE poi_id % 5 <> 0),
t AS (SELECT poi_id, sum(flow_base) AS mu FROM h GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2 AS a, rank() OVER (ORDER BY rc) + (count(*) OVER (PARTITION BY rc) - 1) / 2 AS b FROM t JOIN d USING (poi_id) WHERE el),
sp AS (SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS a, rank() OVER (ORDER BY rc) + (count(*) OVER (PARTITION BY rc) - 1) / 2 AS b FROM d WHERE rc > 0 AND rating IS NOT NULL),
e AS (SELECT count(*) FILTER (poi_id IN (SELECT poi_id FROM h)) AS hit, count(*) AS n FROM d WHERE el),
g AS (SELECT origin_id, avg(gtc) AS mean_gtc FROM h GROUP BY 1),
c AS (SELECT avg(cov) AS cov FROM (SELECT any_value(coverage) AS cov FROM h GROUP BY origin_id))
SELECT 'rating_count_zero' AS "check", count(*) FILTER (rc = 0)::DOUBLE AS value, round_even(count(*) FILTER (rc = 0)::DOUBLE / count(*), 4) AS pct, CASE WHEN count(*) FILTER (rc = 0) < 100 THEN 'OK' ELSE 'WARN' END AS flag FROM d
UNION ALL SELECT 'rating_count_sparse', count(*) FILTER (rc BETWEEN 1 AND 10), round_even(count(*) FILTER (rc BETWEEN 1 AND 10)::DOUBLE / count(*), 4), CASE WHEN count(*) FILTER (rc BETWEEN 1 AND 10) < 50 THEN 'OK' ELSE 'WARN' END FROM d
UNION ALL SELECT 'rating_count_high_outlier', count(*) FILTER (rc > high), round_even(count(*) FILTER (rc > high)::DOUBLE / count(*), 4), 'OK' FROM q
UNION ALL SELECT 'rating_star_descriptive', count(rating), round_even(count(rating)::DOUBLE / count(*), 4), 'INFO' FROM d
UNION ALL SELECT 'lambda_exclusion_check', round_even(corr(a, b), 4), NULL, CASE WHEN abs(corr(a, b)) < 0.15 THEN 'OK' ELSE 'WARN' END FROM sp HAVING count(*) >= 10
UNION ALL SELECT 'rating_subtype_ranking', NULL, NULL, 'INFO'
UNION ALL SELECT 'eligible_pois_pt_coverage', hit, round_even(hit::DOUBLE / n, 4), CASE WHEN hit::DOUBLE / n > 0.85 THEN 'OK' ELSE 'WARN' END FROM e
UNION ALL SELECT 'outside_option_coverage', round_even(cov, 4), NULL, CASE WHEN cov > 0.3 THEN 'OK' ELSE 'WARN' END FROM c
UNION ALL SELECT 'pca_car_gtc_collinearity', round_even(corr(origin_id / 25, mean_gtc), 4), NULL, CASE WHEN abs(corr(origin_id / 25, mean_gtc)) < 0.4 THEN 'OK' ELSE 'WARN' END FROM g
UNION ALL SELECT 'prior_validity_spearman_rho', round_even(corr(a, b), 4), NULL, CASE WHEN corr(a, b) > 0.2 THEN 'OK' ELSE 'WARN' END FROM r
""")
def flow_quality_log(spark, d):
    """Some places lack counts, ratings or skims, so that the checks have something to find."""
    poi = F.col("poi_id")
    od = cut_lineage(flow_table(spark, d).filter(poi % 5 != 0))
    dest = destinations(spark, d).withColumn("rating_count", F.when(poi % 11 == 0, 0).otherwise(F.col("rating_count")))
    dest = dest.withColumn("rating", F.when(poi % 9 != 0, 1 + (poi * 7 % 41) / 10))
    dest = cut_lineage(dest.withColumn("eligible", ((poi % 7 != 0) & (poi % 11 != 0)).cast("int")))
    reached = od.select("poi_id").distinct()
    calibrated = cut_lineage(flow.calibration(dest.filter("eligible = 1").join(reached, "poi_id", "left_semi"), od))
    origins = cut_lineage(flow.car_residual(productions(spark, d), od))
    return flow.quality_log(dest, calibrated, od, origins).drop("note")


PLAN_SQL = OD_SQL.replace("/ 1000 AS gtc", f"/ 1000 + 1.5 / {K.VALUE_OF_TIME!r}::DOUBLE + {K.TRANSFER_PENALTY_MIN!r} AS gtc")


@query("W5 O1 O5 O6 O7 O11", PLAN_SQL + """,
t AS (SELECT poi_id, sum(flow_base) AS mu, sum(greatest(flow_base, 1e-9) * coverage) / sum(greatest(flow_base, 1e-9)) AS cov FROM p GROUP BY 1),
f AS (SELECT sum(rating_count) / sum(mu) AS k FROM t JOIN dest USING (poi_id))
SELECT poi_id, CASE WHEN poi_id % 2 = 0 THEN 0 ELSE 5 END AS cat_fe, scale_cat, rating_count, round(mu * k, 4) AS mu_j, round(cov, 6) AS mean_coverage FROM t JOIN dest USING (poi_id), f
""")
def flow_plan(spark, d):
    """The whole plan from raw tables, with text flags and missing values to clean."""
    origins = productions(spark, d).select("origin_id", "pop_total", "PCA_Car_Proxy_01", "cbd_flag", F.lit(None).cast("int").alias("central_area_flag"))
    dest = destinations(spark, d).select(
        "poi_id", F.when(F.col("poi_id") % 2 == 0, " Mall ").otherwise("Park").alias("subtype"), F.col("scale_m2").alias("footprint_area"),
        F.lit(None).cast("double").alias("gfa"), F.col("rating_count").cast("string").alias("rating_count"),
    )
    skims = od_pairs(spark, d).select(
        "origin_id", "poi_id", F.col("gtc").alias("total_time_min"), F.lit(1).alias("transfers"), F.lit(1.5).alias("pt_fare_proxy"),
        F.lit("True").alias("accessible_flag"), F.lit("OK").alias("error_code"),
    )
    out = flow.run(origins, dest, skims)["dest"]
    return out.select("poi_id", "cat_fe", "scale_cat", "rating_count", F.round("mu_j", 4).alias("mu_j"), F.round("mean_coverage", 6).alias("mean_coverage"))

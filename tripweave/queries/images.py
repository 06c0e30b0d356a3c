"""Image evidence to place scores. Lines stand for image evidence, suppliers for places."""

from pyspark.sql import functions as F

from tripweave.operators import perception
from tripweave.operators.pairwise import group_pair_sums, image_spread_scores
from tripweave.plans import places, sensitivity
from tripweave.queries.registry import query
from tripweave.tables import table

MASK_CLASSES = ["vegetation", "sky", "building", "road", "person", "car", "traffic sign", "pole"]
DETECTED = ["person", "car", "bench", "stop sign", "chair", "zebra"]


def pick(c, names):
    """Name number ``c`` of a list."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))


def listed(names, c):
    return f"([{', '.join(repr(n) for n in names)}])[({c}) % {len(names)} + 1]"


def mask_rows(spark, d):
    return table(
        spark, d, "lineitem", F.col("l_partkey").alias("image_id"), pick(F.col("l_orderkey") + F.col("l_linenumber"), MASK_CLASSES).alias("class"),
        F.col("l_quantity").cast("bigint").alias("n_pixels"),
    )


def detection_rows(spark, d):
    return table(spark, d, "lineitem", F.col("l_partkey").alias("image_id"), pick(F.col("l_suppkey"), DETECTED).alias("class"), (F.col("l_discount") * 10).alias("confidence"))


EVIDENCE = f"""
WITH m AS (SELECT l_partkey AS image_id, {listed(MASK_CLASSES, 'l_orderkey + l_linenumber')} AS class, l_quantity::BIGINT AS n FROM lineitem),
s AS (SELECT image_id, sum(n) AS t, sum(n) FILTER (class = 'vegetation') AS veg, sum(n) FILTER (class = 'person') AS ped, sum(n) FILTER (class = 'traffic sign') AS sign,
  sum(n) FILTER (class = 'pole') AS pole FROM m GROUP BY 1),
x AS (SELECT l_partkey AS image_id, {listed(DETECTED, 'l_suppkey')} AS class FROM lineitem WHERE l_discount * 10 >= 0.3),
e AS (SELECT image_id, count(*) FILTER (class = 'person') AS person, count(*) FILTER (class = 'stop sign') AS stop, count(*) FILTER (class = 'bench') AS bench FROM x GROUP BY 1)
"""


@query("A26", EVIDENCE + """
SELECT image_id, round(coalesce(veg, 0) / t, 8) AS greenery,
  round(coalesce(ped, 0) / t + (1 - coalesce(ped, 0) / t) * least(coalesce(person, 0) / 5, 1) * 0.5, 8) AS pedestrian_presence,
  round(coalesce(sign, 0) / t + (1 - coalesce(sign, 0) / t) * least(coalesce(stop, 0) / 5, 1) * 0.9, 8) AS signage_density,
  round(coalesce(pole, 0) / t + (1 - coalesce(pole, 0) / t) * least(coalesce(bench, 0) / 5, 1) * 0.7, 8) AS street_furniture
FROM s LEFT JOIN e USING (image_id)
""")
def fused_features(spark, d):
    fused = perception.fuse_features(mask_rows(spark, d), detection_rows(spark, d))
    return fused.select("image_id", *[F.round(c, 8).alias(c) for c in ("greenery", "pedestrian_presence", "signage_density", "street_furniture")])


ACTIVITY_SQL = "CASE class WHEN 'person' THEN 'leisure' WHEN 'bench' THEN 'leisure' WHEN 'car' THEN 'transport' WHEN 'stop sign' THEN 'commercial' WHEN 'chair' THEN 'dining' END"


@query("A23 J5", f"""
WITH x AS (SELECT l_partkey AS image_id, {listed(DETECTED, 'l_suppkey')} AS class, l_discount * 10 AS conf FROM lineitem),
k AS (SELECT image_id, {ACTIVITY_SQL} AS kind, count(*) AS n FROM x WHERE conf >= 0.3 GROUP BY 1, 2), q AS (SELECT * FROM k WHERE kind IS NOT NULL),
p AS (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM q),
h AS (SELECT image_id, round(least(greatest(-sum(p * ln(p)) / ln(4), 0), 1), 6) AS v FROM p GROUP BY 1)
SELECT image_id, coalesce(v, 0) AS activity_diversity FROM (SELECT DISTINCT image_id FROM x) LEFT JOIN h USING (image_id)
""")
def activity_mix(spark, d):
    out = perception.activity_diversity(detection_rows(spark, d))
    return out.withColumn("activity_diversity", F.round("activity_diversity", 6))


@query("A24", """
WITH b AS (SELECT l_suppkey AS image_id, l_partkey % 18 AS bin, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM b), h AS (SELECT image_id, -sum(p * ln(p)) / ln(18) AS h FROM p GROUP BY 1),
e AS (SELECT l_suppkey AS image_id, avg(l_discount) * 4 AS edge FROM lineitem GROUP BY 1)
SELECT image_id, round(least(0.6 * least(h, 1) + 0.4 * least(edge / 0.3, 1), 1), 6) AS architectural_variety FROM h JOIN e USING (image_id)
""")
def colour_variety(spark, d):
    li = table(spark, d, "lineitem", F.col("l_suppkey").alias("image_id"), F.pmod("l_partkey", F.lit(18)).alias("bin"), "l_quantity", "l_discount")
    hue = li.groupBy("image_id", "bin").agg(F.sum("l_quantity").alias("n"))
    edges = li.groupBy("image_id").agg((F.avg("l_discount") * 4).alias("edge_density"))
    return perception.architectural_variety(hue, edges).withColumn("architectural_variety", F.round("architectural_variety", 6))


@query("A25", """
SELECT l_suppkey AS image_id, round(0.7 * sum(l_quantity) FILTER (l_partkey % 256 < 80) / sum(l_quantity) + 0.3 * sum(l_quantity) FILTER (l_partkey % 256 < 120) / sum(l_quantity), 6) AS shading_coverage
FROM lineitem GROUP BY 1
""")
def shade_shares(spark, d):
    hist = table(spark, d, "lineitem", F.col("l_suppkey").alias("image_id"), F.pmod("l_partkey", F.lit(256)).alias("bin"), F.col("l_quantity").alias("n"))
    return perception.shading_coverage(hist).withColumn("shading_coverage", F.round("shading_coverage", 6))


FEATURES = ["pedestrian_presence", "building_frontage", "signage_density", "activity_diversity", "greenery", "sky_visibility",
            "architectural_variety", "vehicle_presence", "ground_surface", "shading_coverage", "lighting_presence", "street_furniture"]


def feature_rows(spark, d, *keys):
    """Twelve features in [0, 1] from a line's columns."""
    base = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_extendedprice") / 110000]
    mixed = [base[i % 4] * (1 - (i // 4) / 10) for i in range(12)]
    return table(spark, d, "lineitem").select(*keys, *[c.alias(n) for n, c in zip(FEATURES, mixed)])


@query("F33 W7", """
WITH f AS (SELECT l_suppkey, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12.5 AS c, l_extendedprice / 110000 AS e FROM lineitem),
v AS (SELECT l_suppkey, 0.45 * a + 0.30 * b + 0.20 * c + 0.05 * e AS vib, 0.40 * a * 0.9 + 0.30 * b * 0.9 + 0.20 * c * 0.9 - 0.30 * e * 0.9 AS plea FROM f),
s AS (SELECT min(vib) AS v0, max(vib) AS v1, min(plea) AS p0, max(plea) AS p1 FROM v)
SELECT l_suppkey, round(avg(vib), 6) AS vibrancy, round(avg((vib - v0) / (v1 - v0)), 6) AS vibrancy_std, round(avg((plea - p0) / (p1 - p0)), 6) AS pleasantness_std FROM v, s GROUP BY 1
""")
def perception_dimensions(spark, d):
    dims = places.dimensions(feature_rows(spark, d, "l_suppkey"))
    return dims.groupBy("l_suppkey").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("vibrancy", "vibrancy_std", "pleasantness_std")])


def image_scores(spark, d):
    """Events as images of users, with two scores and messy status and date texts."""
    return table(spark, d, "events", "user_id", "event_type", "value", "ts", "event_id").select(
        F.col("user_id").alias("poi_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("captured_at"),
        F.when(F.col("event_type") == "view", "TRUE").otherwise("false").alias("is_panorama"),
        F.col("value").alias("vibrancy"), F.sqrt("value").alias("safety"),
    )


USED = """
WITH i AS (SELECT user_id AS poi_id, event_type = 'view' AS pano, value AS x, sqrt(value) AS y, date_diff('day', ts::DATE, DATE '2024-01-25') AS age FROM events
  WHERE event_type <> 'error' AND event_id % 50 <> 0 AND ts::DATE <= DATE '2024-01-25'),
w AS (SELECT *, exp(-ln(2) / 365 * age) * CASE WHEN pano THEN 1.0 ELSE 0.75 END AS w FROM i),
a AS (SELECT poi_id, count(*) AS n_images, sum(w) * sum(w) / sum(w * w) AS n_eff, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, quantile_cont(age, 0.5) AS med, count(*) FILTER (pano) AS n_panos FROM w GROUP BY 1)
"""


@query("A8 A9 F10 F11 F12", USED + "SELECT poi_id, n_images, n_panos, med AS median_image_age, round(n_eff, 6) AS n_eff, round(mx, 6) AS vibrancy_mean FROM a")
def place_image_stats(spark, d):
    weighted = perception.image_weights(image_scores(spark, d), "2024-01-25")
    out = places.place_stats(weighted, "poi_id", ["vibrancy", "safety"])
    return out.select("poi_id", "n_images", "n_panos", "median_image_age", F.round("n_eff", 6).alias("n_eff"), F.round("vibrancy_mean", 6).alias("vibrancy_mean"))


@query("O12 J17 A11 W10", USED + """,
p AS (SELECT c_custkey AS poi_id, c_mktsegment AS cat, CASE WHEN c_nationkey < 20 THEN 'N' || c_nationkey ELSE 'unknown' END AS area FROM customer),
j AS (SELECT p.*, coalesce(n_images, 0) AS n, coalesce(n_eff, 0) AS ne, mx FROM p LEFT JOIN a USING (poi_id)),
c AS (SELECT cat, avg(mx) AS c FROM j WHERE n > 0 GROUP BY 1), r AS (SELECT area, avg(mx) AS r FROM j WHERE n > 0 GROUP BY 1), g AS (SELECT avg(mx) AS g FROM j WHERE n > 0),
q AS (SELECT j.*, 0.6 * coalesce(c, g) + 0.4 * coalesce(r, g) AS prior FROM j LEFT JOIN c USING (cat) LEFT JOIN r USING (area), g),
f AS (SELECT poi_id, CASE WHEN n = 0 THEN 'no_image' WHEN ne >= 5 THEN 'normal' ELSE 'shrinkage' END AS aggregation_method, prior,
  CASE WHEN n = 0 THEN prior WHEN ne >= 5 THEN mx ELSE (ne * mx + 4 * prior) / (ne + 4) END AS v FROM q),
z AS (SELECT quantile_cont(v, 0.25) AS z1, quantile_cont(v, 0.5) AS z2, quantile_cont(v, 0.75) AS z3 FROM f)
SELECT poi_id, aggregation_method, round(prior, 6) AS vibrancy_prior, round(v, 6) AS vibrancy, round((v - z2) / (z3 - z1), 4) AS vibrancy_robust_z FROM f, z
""")
def shrunken_scores(spark, d):
    area = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("N"), F.col("c_nationkey")))
    spots = table(spark, d, "customer", F.col("c_custkey").alias("poi_id"), F.col("c_mktsegment").alias("subtype"), area.alias("planning_area"))
    out = places.score_places(image_scores(spark, d), spots, "2024-01-25", ["vibrancy"])
    return out.select(
        "poi_id", "aggregation_method", F.round("vibrancy_prior", 6).alias("vibrancy_prior"), F.round("vibrancy", 6).alias("vibrancy"), F.round("vibrancy_robust_z", 4).alias("vibrancy_robust_z")
    )


@query("O13 O14 O12", """
WITH g AS (SELECT * FROM (VALUES (0, 365.0::DOUBLE, 4.0::DOUBLE, 0.6::DOUBLE), (1, 270.0, 4.0, 0.6), (2, 730.0, 4.0, 0.6), (3, 365.0, 2.0, 0.6), (4, 365.0, 15.0, 0.6), (5, 365.0, 4.0, 0.0), (6, 365.0, 4.0, 1.0)) v(tag, hl, kappa, alpha)),
i AS (SELECT user_id AS poi_id, event_type = 'view' AS pano, value AS x, sqrt(value) AS y, date_diff('day', ts::DATE, DATE '2024-01-25') AS age FROM events
  WHERE event_type <> 'error' AND event_id % 50 <> 0 AND ts::DATE <= DATE '2024-01-25'),
w AS (SELECT *, exp(-ln(2) / hl * age) * CASE WHEN pano THEN 1.0 ELSE 0.75 END AS w FROM i, (SELECT DISTINCT hl FROM g)),
a AS (SELECT poi_id, hl, count(*) AS n_images, sum(w) * sum(w) / sum(w * w) AS n_eff, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1, 2),
p AS (SELECT c_custkey AS poi_id, c_acctbal AS outcome, c_mktsegment AS cat, CASE WHEN c_nationkey < 20 THEN 'N' || c_nationkey ELSE 'unknown' END AS area FROM customer),
j AS (SELECT p.*, g.*, coalesce(n_images, 0) AS n, coalesce(n_eff, 0) AS ne, mx, my FROM p CROSS JOIN g LEFT JOIN a ON a.poi_id = p.poi_id AND a.hl = g.hl),
c AS (SELECT tag, cat, avg(mx) AS cx, avg(my) AS cy FROM j WHERE n > 0 GROUP BY 1, 2), r AS (SELECT tag, area, avg(mx) AS rx, avg(my) AS ry FROM j WHERE n > 0 GROUP BY 1, 2),
o AS (SELECT tag, avg(mx) AS gx, avg(my) AS gy FROM j WHERE n > 0 GROUP BY 1),
q AS (SELECT j.*, alpha * coalesce(cx, gx) + (1 - alpha) * coalesce(rx, gx) AS px, alpha * coalesce(cy, gy) + (1 - alpha) * coalesce(ry, gy) AS py
  FROM j LEFT JOIN c USING (tag, cat) LEFT JOIN r USING (tag, area) JOIN o USING (tag)),
f AS (SELECT tag, outcome, CASE WHEN n = 0 THEN px WHEN ne >= 5 THEN mx ELSE (ne * mx + kappa * px) / (ne + kappa) END AS vx,
  CASE WHEN n = 0 THEN py WHEN ne >= 5 THEN my ELSE (ne * my + kappa * py) / (ne + kappa) END AS vy FROM q),
t AS (SELECT tag, 'vibrancy' AS parameter, vx AS v, outcome FROM f UNION ALL SELECT tag, 'safety', vy, outcome FROM f),
m AS (SELECT tag, parameter, regr_slope(outcome, v) AS b, sqrt((regr_syy(outcome, v) - regr_slope(outcome, v) * regr_sxy(outcome, v)) / (count(*) - 2) / regr_sxx(outcome, v)) AS sd FROM t GROUP BY 1, 2),
z AS (SELECT parameter, b AS b0, sd AS s0 FROM m WHERE tag = 0)
SELECT parameter, round(any_value(b0), 4) AS base_mean, round(any_value(s0), 4) AS base_sd, round(max(abs(b - b0)), 4) AS max_shift, bool_and((abs(b) > 1.96 * sd) = (abs(b0) > 1.96 * s0)) AS verdict_stable,
  bool_and((abs(b) > 1.96 * sd) = (abs(b0) > 1.96 * s0)) AND max(abs(b - b0)) < any_value(s0) AS robust FROM m JOIN z USING (parameter) GROUP BY 1
""")
def score_robustness(spark, d):
    """Does the effect of place scores on an outcome hold under other half-lives, strengths and mixes?"""
    area = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("N"), F.col("c_nationkey")))
    spots = table(spark, d, "customer", F.col("c_custkey").alias("poi_id"), F.col("c_acctbal").alias("outcome"), F.col("c_mktsegment").alias("subtype"), area.alias("planning_area"))
    scores = sensitivity.score_grid(image_scores(spark, d), spots, "2024-01-25", ["vibrancy", "safety"])
    out = sensitivity.judge(sensitivity.score_effects(scores, "outcome", ["vibrancy", "safety"]))
    return out.select("parameter", *[F.round(c, 4).alias(c) for c in ("base_mean", "base_sd", "max_shift")], "verdict_stable", "robust")


IMG = """
WITH i AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN embedding[3] > -0.1 THEN 180 + 500 * embedding[3]::DOUBLE END AS h FROM embeddings)
"""


def image_points(spark, d):
    """Vectors as located images with a heading, grouped by label."""
    e = F.col("embedding")
    heading = F.when(e[2] > -0.1, 180 + 500 * e[2].cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("poi"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), heading.alias("h"))


@query("J13", IMG + """
SELECT a.label::VARCHAR AS poi, a.vec_id, round(sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS spatial,
  round(sum(CASE WHEN a.h IS NULL OR b.h IS NULL THEN 0 ELSE least(abs(a.h - b.h), 360 - abs(a.h - b.h)) END), 4) AS angular
FROM i a JOIN i b ON a.label = b.label GROUP BY 1, 2
""")
def pair_distance_sums(spark, d):
    p = image_points(spark, d)
    sums = group_pair_sums(p, "poi", "x", "y", "h", block=16, density=False)
    joined = p.join(sums.withColumnRenamed("h", "_h"), ["poi", "x", "y"]).filter(F.col("h").eqNullSafe(F.col("_h")))
    return joined.select("poi", "vec_id", F.round("spatial", 6).alias("spatial"), F.round("angular", 4).alias("angular"))


@query("W11 W14", IMG + """,
n AS (SELECT label, count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM i GROUP BY 1),
p AS (SELECT a.label, a.vec_id, n, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s, CASE WHEN a.h IS NULL OR b.h IS NULL THEN 0 ELSE least(abs(a.h - b.h), 360 - abs(a.h - b.h)) END AS g,
  exp(-0.5 * (vy * pow(a.x - b.x, 2) - 2 * c * (a.x - b.x) * (a.y - b.y) + vx * pow(a.y - b.y, 2)) / (vx * vy - c * c) / pow(n, -1/3))
    / (2 * pi() * sqrt(vx * vy - c * c) * pow(n, -1/3)) / n AS k FROM i a JOIN i b ON a.label = b.label JOIN n ON n.label = a.label),
q AS (SELECT *, max(s) OVER (PARTITION BY label) AS sm, max(g) OVER (PARTITION BY label) AS gm FROM p),
r AS (SELECT label, vec_id, sum(0.6 * s / sm + 0.4 * g / gm) / (any_value(n) - 1) AS d, 1 / (1 + ln(sum(k) + 1)) AS b FROM q GROUP BY 1, 2)
SELECT label::VARCHAR AS poi, vec_id, round(d / max(d) OVER (PARTITION BY label), 6) AS diversity,
  round((b - min(b) OVER (PARTITION BY label)) / (max(b) OVER (PARTITION BY label) - min(b) OVER (PARTITION BY label)), 6) AS balance FROM r
""")
def spread_scores(spark, d):
    p = image_points(spark, d)
    scores = image_spread_scores(p, "poi", "x", "y", "h").withColumnRenamed("h", "_h")
    joined = p.join(scores, ["poi", "x", "y"]).filter(F.col("h").eqNullSafe(F.col("_h")))
    return joined.select("poi", "vec_id", F.round("diversity", 6).alias("diversity"), F.round("balance", 6).alias("balance"))


@query("O16 W8 W11 W12 W13 W14 O15")
def refined_images(spark, d):
    """The full image selection per place."""
    e = F.col("embedding")
    images = image_points(spark, d).select(F.concat(F.pmod(F.col("poi").cast("int"), F.lit(9)).cast("string"), F.lit("_XX_"), "poi").alias("POI_ID"), F.col("vec_id").alias("image_id"), "x", "y", "h")
    flags = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (e[3] > 0).alias("is_panorama"), (2017 + F.pmod("vec_id", F.lit(9))).cast("int").alias("image_year"))
    registry = perception.prefilter_images(images.join(flags, "image_id"), ["image_id"])
    chosen = perception.refine_images(registry, "POI_ID", "x", "y", "h")
    return chosen.select("POI_ID", "image_id", F.round("composite_score", 6).alias("composite_score"))



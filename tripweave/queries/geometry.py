"""Polygons, spatial joins, sampling and spatial de-duplication on points from embedding dimensions."""

from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions import geo
from tripweave.operators import dedup, spatial
from tripweave.plans import attributes
from tripweave.queries.registry import query
from tripweave.tables import table

SIDE = 100.0


def points(spark, d, *extra):
    """Vectors as points in metres: the first two dimensions times 1000."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", (e[0].cast("double") * 1000).alias("x"), (e[1].cast("double") * 1000).alias("y"), "label", *extra
    )


PTS = "SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label FROM embeddings"


def zones(spark, d):
    """Square zones over the cells that hold points, each with a square hole in its middle."""
    grid = spatial.square_grid(points(spark, d), "x", "y", SIDE)
    x0, y0 = F.col("gx") * SIDE, F.col("gy") * SIDE
    hole = geo.box_ring(x0 + 40, y0 + 40, x0 + 60, y0 + 60)
    return grid.select("gx", "gy", geo.orient(F.col("rings"), F.array(hole)).alias("rings"))


@query("G1 G2 G3 S13", """
WITH g AS (SELECT DISTINCT floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM (""" + PTS + """))
SELECT gx, gy, 9600.0::DOUBLE AS area, gx * 100 + 50.0::DOUBLE AS cx, gy * 100 + 50.0::DOUBLE AS cy, TRUE AS inside FROM g
""")
def zone_measures(spark, d):
    z = zones(spark, d).withColumn("p", geo.interior_point(F.col("rings"))).withColumn("c", geo.polygon_centroid(F.col("rings")))
    return z.select(
        "gx", "gy", F.round(geo.polygon_area(F.col("rings")), 6).alias("area"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"),
        geo.contains(F.col("rings"), F.col("p.x"), F.col("p.y")).alias("inside"),
    )


@query("J11", """
WITH p AS (SELECT *, floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM (""" + PTS + """))
SELECT vec_id, CASE WHEN x - gx * 100 BETWEEN 40 AND 60 AND y - gy * 100 BETWEEN 40 AND 60 THEN NULL ELSE gx END AS zone_x,
  CASE WHEN x - gx * 100 BETWEEN 40 AND 60 AND y - gy * 100 BETWEEN 40 AND 60 THEN NULL ELSE gy END AS zone_y
FROM p
""")
def point_in_zone(spark, d):
    z = zones(spark, d).withColumn("k", F.concat_ws(",", "gx", "gy"))
    p = points(spark, d)
    out = spatial.point_in_polygon(p, "vec_id", "x", "y", z, "rings", "k", ["gx", "gy"])
    return out.select("vec_id", F.col("gx").alias("zone_x"), F.col("gy").alias("zone_y"))


AREAS = ["bedok", "Newton", "Downtown Core", "Straits View", "Yishun"]


@query("J11 F16", """
WITH p AS (SELECT *, floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM (""" + PTS + """)),
z AS (SELECT vec_id, gx || ',' || gy AS subzone, upper(['bedok', 'Newton', 'Downtown Core', 'Straits View', 'Yishun'][((gx + 3 * gy) % 5 + 5) % 5 + 1]) AS area,
  x - gx * 100 BETWEEN 40 AND 60 AND y - gy * 100 BETWEEN 40 AND 60 AS hole FROM p)
SELECT vec_id, CASE WHEN hole THEN '' ELSE area END AS planning_area, CASE WHEN hole THEN '' ELSE subzone END AS subzone,
  (NOT hole AND area IN ('DOWNTOWN CORE', 'STRAITS VIEW'))::INTEGER AS cbd_flag, (NOT hole AND area IN ('DOWNTOWN CORE', 'STRAITS VIEW', 'NEWTON'))::INTEGER AS central_area_flag FROM z
""")
def place_planning_areas(spark, d):
    z = zones(spark, d).withColumn("subzone", F.concat_ws(",", "gx", "gy"))
    z = z.withColumn("planning_area", F.element_at(F.array(*[F.lit(a) for a in AREAS]), (F.pmod(F.col("gx") + 3 * F.col("gy"), F.lit(5)) + 1).cast("int")))
    out = attributes.planning_areas(points(spark, d), z.select("subzone", "planning_area", "rings"), "vec_id")
    return out.select("vec_id", "planning_area", "subzone", "cbd_flag", "central_area_flag")


@query("J12", """
WITH p AS (""" + PTS + """), b AS (SELECT DISTINCT floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM p)
SELECT vec_id, gx, gy, round(sqrt(pow(greatest(gx * 100 - x, x - gx * 100 - 100, 0), 2) + pow(greatest(gy * 100 - y, y - gy * 100 - 100, 0), 2)), 6) AS dist
FROM p, b WHERE sqrt(pow(greatest(gx * 100 - x, x - gx * 100 - 100, 0), 2) + pow(greatest(gy * 100 - y, y - gy * 100 - 100, 0), 2)) <= 50
""")
def zones_within_distance(spark, d):
    p = points(spark, d)
    boxes = spatial.square_grid(p, "x", "y", SIDE)
    near = spatial.within_distance(p.select("vec_id", "x", "y"), "x", "y", boxes, "rings", 50.0)
    return near.select("vec_id", "gx", "gy", F.round("dist", 6).alias("dist"))


@query("K3", """
WITH p AS (""" + PTS + """), b AS (SELECT DISTINCT floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM p),
n AS (SELECT vec_id, gx, gy, sqrt(pow(greatest(gx * 100 - x, x - gx * 100 - 100, 0), 2) + pow(greatest(gy * 100 - y, y - gy * 100 - 100, 0), 2)) AS dist FROM p, b)
SELECT vec_id, gx || ',' || gy AS zone, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, gx || ',' || gy)::INTEGER AS rank FROM n WHERE dist <= 100) WHERE rank <= 3
""")
def candidate_zones(spark, d):
    p = points(spark, d)
    boxes = spatial.square_grid(p, "x", "y", SIDE).withColumn("zone", F.concat_ws(",", "gx", "gy"))
    ranked = spatial.candidate_list(p.select("vec_id", "x", "y"), "vec_id", "x", "y", boxes, "zone", "rings", 100.0, 3)
    return ranked.select("vec_id", "zone", "rank")


@query("G4", """
WITH p AS (""" + PTS + """), r AS (SELECT label, round(x)::BIGINT AS x0, round(y)::BIGINT AS y0 FROM p),
c AS (SELECT DISTINCT label, x0 + i AS cx, y0 + j AS cy FROM r, range(0, 30) t(i), range(0, 20) u(j))
SELECT label, count(*)::DOUBLE AS area FROM c GROUP BY 1
""")
def union_areas(spark, d):
    x0, y0 = F.round("x").cast("double"), F.round("y").cast("double")
    boxes = points(spark, d).select("label", F.array(geo.box_ring(x0, y0, x0 + 30, y0 + 20)).alias("rings"))
    return spatial.union_area(boxes, ["label"], "rings", "area").withColumn("area", F.round("area", 4))


@query("G5", """
WITH p AS (""" + PTS + """), n AS (SELECT *, x + 37.5 AS x1 FROM p),
s AS (SELECT vec_id, x, y, x1, 37.5 + (label + 1) * 10 AS len FROM n), k AS (SELECT *, unnest(range(0, ceil(len / 12)::BIGINT)) AS step FROM s)
SELECT vec_id, step, round(CASE WHEN step * 12 < 37.5 THEN x + step * 12 ELSE x1 END, 6) AS px, round(CASE WHEN step * 12 < 37.5 THEN y ELSE y + step * 12 - 37.5 END, 6) AS py FROM k
""")
def points_along_lines(spark, d):
    def at(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x, y = F.col("x"), F.col("y")
    lines = points(spark, d).select("vec_id", F.array(at(x, y), at(x + 37.5, y), at(x + 37.5, y + (F.col("label") + 1) * 10.0)).alias("line"))
    out = spatial.points_along(lines, "vec_id", "line", 12.0)
    return out.select("vec_id", "step", F.round("x", 6).alias("px"), F.round("y", 6).alias("py"))


@query("G6", """
SELECT vec_id, radius::DOUBLE AS radius, step::INTEGER AS step, round(x + radius * cos(radians(45.0 * step)), 6) AS px, round(y + radius * sin(radians(45.0 * step)), 6) AS py
FROM (""" + PTS + """), (VALUES (50), (100), (150), (200)) r(radius), range(0, 8) s(step)
""")
def ring_samples(spark, d):
    out = spatial.ring_points(points(spark, d), "x", "y")
    return out.select("vec_id", "radius", "step", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("G7 G9", """
WITH p AS (SELECT vec_id, CASE label WHEN 0 THEN 'Park' WHEN 1 THEN 'monument' WHEN 2 THEN 'mall' WHEN 3 THEN 'school' ELSE 'lifestyle_street' END AS subtype,
  1.3 + embedding[1]::DOUBLE / 10 AS lat, 103.8 + embedding[2]::DOUBLE / 10 AS lon FROM embeddings)
SELECT vec_id, CASE subtype WHEN 'Park' THEN 50 WHEN 'monument' THEN 150 WHEN 'mall' THEN 300 ELSE 80 END::DOUBLE AS buffer_m,
  CASE subtype WHEN 'Park' THEN 50 WHEN 'monument' THEN 30 WHEN 'mall' THEN 40 ELSE 25 END::DOUBLE AS spacing_m,
  CASE subtype WHEN 'Park' THEN 'park_near_edge' WHEN 'monument' THEN 'landmark_radial' WHEN 'mall' THEN 'network_accessibility' ELSE 'street_corridor' END AS source,
  CASE WHEN subtype = 'monument' THEN round((degrees(atan2(sin(radians(103.85 - lon)) * cos(radians(1.35)),
    cos(radians(lat)) * sin(radians(1.35)) - sin(radians(lat)) * cos(radians(1.35)) * cos(radians(103.85 - lon)))) + 360) % 360, 6) END AS target_heading
FROM p WHERE subtype <> 'school'
""")
def sampling_plans(spark, d):
    e, label = F.col("embedding"), F.col("label")
    kind = F.when(label == 0, "Park").when(label == 1, "monument").when(label == 2, "mall").when(label == 3, "school").otherwise("lifestyle_street")
    p = table(spark, d, "embeddings").select("vec_id", kind.alias("subtype"), (F.lit(1.3) + e[0].cast("double") / 10).alias("lat"), (F.lit(103.8) + e[1].cast("double") / 10).alias("lon"))
    planned = spatial.with_sampling_plan(p, "subtype")
    heading = spatial.target_heading(F.col("subtype"), F.col("lat"), F.col("lon"), F.lit(1.35), F.lit(103.85))
    return planned.select("vec_id", "buffer_m", "spacing_m", "source", F.round(heading, 6).alias("target_heading"))


@query("G8", """
WITH p AS (""" + PTS + """), b AS (SELECT DISTINCT floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM p),
c AS (SELECT vec_id, x, y, gx, gy, gx * 100.0 AS x0, gx * 100.0 + 100 AS x1, gy * 100.0 AS y0, gy * 100.0 + 100 AS y1 FROM p, b
  WHERE gx * 100 - 30 <= x + 80 AND x <= gx * 100 + 130 AND gy * 100 - 30 <= y + 10 AND y <= gy * 100 + 130),
k AS (SELECT vec_id, x, y, gx, gy, x0, x1, y0, y1, unnest([x0, x0, x1, x1]) AS kx, unnest([y0, y1, y0, y1]) AS ky FROM c),
t AS (SELECT *, least(1, greatest(0, ((kx - x) * 80 + (ky - y) * 10) / 6500)) AS u FROM k),
m AS (SELECT vec_id, gx, gy, min(sqrt(pow(x + 80 * u - kx, 2) + pow(y + 10 * u - ky, 2))) AS corner,
  any_value(least(sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)), sqrt(pow(greatest(x0 - x - 80, x + 80 - x1, 0), 2) + pow(greatest(y0 - y - 10, y + 10 - y1, 0), 2)))) AS ends,
  any_value(greatest(0, (x0 - x) / 80, (y0 - y) / 10) <= least(1, (x1 - x) / 80, (y1 - y) / 10)) AS meets FROM t GROUP BY 1, 2, 3)
SELECT gx, gy, count(*) AS edges FROM m WHERE meets OR least(corner, ends) <= 25 GROUP BY 1, 2
""")
def edges_near_zones(spark, d):
    x, y = F.col("x"), F.col("y")
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 80).alias("x"), (y + 10).alias("y")))
    p = points(spark, d)
    near = spatial.edges_near(p.select("vec_id", line.alias("line")), "vec_id", "line", spatial.square_grid(p, "x", "y", SIDE), "rings", 25.0)
    return near.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("edges"))


@query("G8", """
WITH p AS (""" + PTS + """), b AS (SELECT DISTINCT floor(x / 100)::BIGINT AS gx, floor(y / 100)::BIGINT AS gy FROM p),
s AS (SELECT vec_id, x, y, 80.0::DOUBLE AS dx, 10.0::DOUBLE AS dy FROM p UNION ALL SELECT vec_id, x + 80, y + 10, -30.0::DOUBLE, 60.0::DOUBLE FROM p),
c AS (SELECT vec_id, gx, gy, x, y, dx, dy, gx * 100.0 AS x0, gx * 100.0 + 100 AS x1, gy * 100.0 AS y0, gy * 100.0 + 100 AS y1 FROM s, b
  WHERE gx * 100 - 30 <= greatest(x, x + dx) AND least(x, x + dx) <= gx * 100 + 130 AND gy * 100 - 30 <= y + dy AND y <= gy * 100 + 130),
k AS (SELECT *, unnest([x0, x0, x1, x1]) AS kx, unnest([y0, y1, y0, y1]) AS ky FROM c),
q AS (SELECT vec_id, gx, gy, x, y, dx, dy, dx * dx + dy * dy AS a, (x - kx) * dx + (y - ky) * dy AS h, pow(x - kx, 2) + pow(y - ky, 2) - 625 AS m FROM k),
i AS (SELECT vec_id, gx, gy, x, y, dx, dy, (-h - sqrt(h * h - a * m)) / a AS lo, (-h + sqrt(h * h - a * m)) / a AS hi FROM q WHERE h * h >= a * m
  UNION ALL SELECT vec_id, gx, gy, x, y, dx, dy, greatest(least((x0 - 25 - x) / dx, (x1 + 25 - x) / dx), (y0 - y) / dy), least(greatest((x0 - 25 - x) / dx, (x1 + 25 - x) / dx), (y1 - y) / dy) FROM c
  UNION ALL SELECT vec_id, gx, gy, x, y, dx, dy, greatest(least((x0 - x) / dx, (x1 - x) / dx), (y0 - 25 - y) / dy), least(greatest((x0 - x) / dx, (x1 - x) / dx), (y1 + 25 - y) / dy) FROM c),
u AS (SELECT vec_id, gx, gy, x, dx, dy, (least(max(hi), 1) - greatest(min(lo), 0)) * sqrt(dx * dx + dy * dy) AS len FROM (SELECT * FROM i WHERE least(hi, 1) > greatest(lo, 0)) GROUP BY 1, 2, 3, 4, 5, 6)
SELECT vec_id, gx, gy, round(sum(len), 5) AS length FROM u WHERE len > 1e-5 GROUP BY 1, 2, 3
""")
def clipped_edges(spark, d):
    """Length of each bent line inside each zone grown by 25 metres, from its clipped pieces."""
    def at(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x, y = F.col("x"), F.col("y")
    p = points(spark, d)
    lines = p.select("vec_id", F.array(at(x, y), at(x + 80, y + 10), at(x + 50, y + 70)).alias("line"))
    cut = spatial.clip_edges(lines, "vec_id", "line", spatial.square_grid(p, "x", "y", SIDE), "rings", 25.0).filter("length > 1e-5")
    return cut.groupBy("vec_id", "gx", "gy").agg(F.round(F.sum("length"), 5).alias("length"))


@query("G10 J14")
def spatial_clusters(spark, d):
    """Clusters of points within the source's distance, per label, and their representatives."""
    source = F.when(F.col("vec_id") % 2 == 0, "network_accessibility").otherwise("landmark_radial")
    p = points(spark, d).withColumn("source", source)
    eps = F.when(F.col("source") == "network_accessibility", K.EPS_BY_SOURCE["network_accessibility"]).otherwise(K.EPS_BY_SOURCE["landmark_radial"])
    clustered = dedup.cluster_points(p.withColumn("eps", eps), ["label", "source"], "x", "y", "eps")
    return dedup.representatives(clustered, "cluster", "x", "y", "vec_id").select("vec_id", "label", "source")


@query("G11 W18", """
WITH p AS (SELECT label, floor(x / 50) AS cx, floor(y / 50) AS cy FROM (""" + PTS + """))
SELECT label, count(*) AS count_before, count(DISTINCT (cx, cy)) AS count_after, round(1 - count(DISTINCT (cx, cy)) / count(*), 6) AS reduction_ratio FROM p GROUP BY 1
""")
def cell_dedup_summary(spark, d):
    p = points(spark, d).withColumn("cell", F.concat_ws(",", "label", F.floor(F.col("x") / 50), F.floor(F.col("y") / 50)))
    kept = dedup.representatives(p, "cell", "x", "y", "vec_id")
    return dedup.dedup_summary(p, kept, ["label"]).withColumn("reduction_ratio", F.round("reduction_ratio", 6))


@query("W18", """
WITH p AS (SELECT *, label || ',' || floor(x / 50)::BIGINT || ',' || floor(y / 50)::BIGINT AS cell FROM (""" + PTS + """)),
c AS (SELECT cell, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT cell, x, y FROM p) GROUP BY 1)
SELECT cell, arg_min(vec_id, (round(sqrt(pow(x - mx, 2) + pow(y - my, 2)), 6), vec_id)) AS vec_id FROM p JOIN c USING (cell) GROUP BY 1
""")
def cell_representatives(spark, d):
    p = points(spark, d).withColumn("cell", F.concat_ws(",", "label", F.floor(F.col("x") / 50), F.floor(F.col("y") / 50)))
    return dedup.representatives(p, "cell", "x", "y", "vec_id").select("cell", "vec_id")


@query("J16 G4 P10 F37")
def footprint_cascade(spark, d):
    """Vectors as places, zones as features: containing, named nearby, largest nearby, none."""
    p = points(spark, d)
    kind = F.when(F.col("label") < 4, "mall").when(F.col("label") < 7, "park").otherwise("museum")
    places = p.select(F.col("vec_id").alias("poi_id"), F.concat(F.lit("Centre number "), F.col("label")).alias("name"), kind.alias("subtype"), "x", "y")
    grid = spatial.square_grid(p, "x", "y", 30.0)
    features = grid.select(
        F.concat_ws(",", "gx", "gy").alias("osm_id"), F.concat(F.lit("centre number "), F.pmod("gx", F.lit(10))).alias("feature_name"),
        F.when(F.pmod(F.col("gx") + F.col("gy"), F.lit(2)) == 0, "mall").otherwise("").alias("shop"),
        F.when(F.pmod(F.col("gx"), F.lit(3)) == 0, "park").otherwise("").alias("leisure"), "rings",
    )
    out = spatial.match_footprints(places, features)
    return out.select("poi_id", "match_type", "n_polygons", F.round("footprint_area", 4).alias("footprint_area"))


@query("G12 J1", """
WITH p AS (SELECT c_nationkey, sum(greatest(c_acctbal, 0)) AS pop FROM customer GROUP BY 1)
SELECT n_nationkey, round(pop / nullif(n_regionkey * 100, 0), 6) AS density FROM nation LEFT JOIN p ON n_nationkey = c_nationkey
""")
def population_density(spark, d):
    pop = table(spark, d, "customer", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("pop"))
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").join(pop, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_nationkey", F.round(F.try_divide("pop", F.col("n_regionkey") * 100.0), 6).alias("density"))

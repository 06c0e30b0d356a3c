"""Scaling, ranking, quotas, samples and running ids."""

from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.numeric import composite
from tripweave.operators import ranking, scaling
from tripweave.operators.perception import composite_score, image_capacity, prefilter_images, recency
from tripweave.operators.quantiles import average_ranks, exact_quantiles, running_total
from tripweave.queries.registry import query
from tripweave.tables import table


@query("W8", """
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y FROM lineitem),
s AS (SELECT l_suppkey, y, min(y) OVER (PARTITION BY l_suppkey) AS lo, max(y) OVER (PARTITION BY l_suppkey) AS hi FROM y)
SELECT l_suppkey, y::INTEGER AS image_year, count(*) AS n, round(max(CASE WHEN hi = lo THEN 1.0 ELSE (y - lo) / (hi - lo) END), 6) AS recency FROM s GROUP BY 1, 2
""")
def recency_scores(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", F.year("l_shipdate").alias("image_year"))
    scored = recency(li, "l_suppkey", "image_year")
    return scored.groupBy("l_suppkey", "image_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("recency"), 6).alias("recency"))


@query("W7", """
WITH s AS (SELECT p_partkey, p_size, p_brand, min(p_size) OVER (PARTITION BY p_brand) AS lo, max(p_size) OVER (PARTITION BY p_brand) AS hi FROM part)
SELECT p_partkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (p_size - lo) / (hi - lo) END, 6) AS scaled FROM s
""")
def min_max_by_group(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    return scaling.min_max(p, "p_size", "scaled", ["p_brand"]).select("p_partkey", F.round("scaled", 6).alias("scaled"))


@query("W9", """
WITH x AS (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS a, (c_custkey % 97)::DOUBLE AS b FROM customer),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x WHERE a IS NOT NULL)
SELECT c_custkey, round((a - ma) / sa, 6) AS a_z, CASE WHEN a IS NOT NULL THEN round((b - mb) / sb, 6) END AS b_z FROM x, s
""")
def population_z_scores(spark, d):
    a = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))
    x = table(spark, d, "customer", "c_custkey", a.alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"))
    return scaling.z_scores(x, ["a", "b"]).select("c_custkey", F.round("a_z", 6).alias("a_z"), F.round("b_z", 6).alias("b_z"))


@query("W10", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT o_orderkey, round((o_totalprice - b) / (c - a), 6) AS z FROM orders, q
""")
def robust_z_scores(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return scaling.robust_z(o, "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query("W12", """
WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate, l_returnflag = 'R' AS pano,
    row_number() OVER (PARTITION BY l_suppkey, l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey * 100 + l_linenumber, l_shipdate) AS k FROM lineitem),
r AS (SELECT *, NOT pano OR k <= 12 AS allowed FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY allowed DESC, l_extendedprice DESC, l_orderkey * 100 + l_linenumber) AS n FROM r)
SELECT l_suppkey, l_extendedprice, pano FROM f WHERE n <= 40
""")
def quota_selection(spark, d):
    li = table(
        spark, d, "lineitem", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("pano"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
    )
    return ranking.quota_top_n(li, "l_suppkey", "l_extendedprice", "id", F.col("pano"), 40, 0.30, 40).drop("id")


def _by_subtype(codes, other):
    cases = " ".join(f"WHEN '{code}' THEN {n}" for code, n in codes.items())
    return f"CASE (o_custkey % 10)::VARCHAR {cases} ELSE {other} END"


@query("W13", f"""
WITH g AS (SELECT o_custkey, {_by_subtype(K.MIN_IMAGES, K.MIN_IMAGES_DEFAULT)} AS least_n, {_by_subtype(K.CAPACITY, K.CAPACITY_DEFAULT)} AS most, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n, CASE WHEN n < least_n THEN 'keep all' ELSE 'select' END AS rule, least(most, n)::BIGINT AS capacity FROM g
""")
def group_capacity(spark, d):
    """Orders as images of customers, whose last digit is the subtype."""
    key = F.concat_ws("_", F.col("o_custkey") % 10, "o_custkey")
    sized = image_capacity(table(spark, d, "orders", "o_custkey", key.alias("place")), "place").distinct()
    rule = F.when(F.col("n_images") < F.col("min_images"), "keep all").otherwise("select").alias("rule")
    return sized.select("o_custkey", F.col("n_images").alias("n"), rule, "capacity")


@query("W15", """
SELECT event_id, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS avg_rank
FROM (SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events)
""")
def tied_ranks(spark, d):
    ev = table(spark, d, "events", "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return average_ranks(ev, "k", "avg_rank").select("event_id", "avg_rank")


@query("W16 W17", """
SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS person_id, dense_rank() OVER (ORDER BY event_type || '_' || user_id::VARCHAR) - 1 AS obs FROM events
""")
def running_ids(spark, d):
    key = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    ev = table(spark, d, "events", "event_id", "event_type", key.alias("k"))
    numbered = ranking.running_id(ev, ["event_type", "event_id"], "person_id")
    return ranking.observation_index(numbered, "k", "obs").select("event_id", "person_id", "obs")


@query("W20", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 5 = 0 THEN 3 END AS block FROM part
""")
def first_answered_block(spark, d):
    from tripweave.operators.survey import first_present

    size = F.col("p_size")
    wide = table(spark, d, "part", "p_partkey", "p_size").select(
        "p_partkey", F.when(size % 4 == 0, "2").otherwise("").alias("Q1"), F.when(size % 3 == 0, "1").alias("Q2"), F.when(size % 5 == 0, "3").alias("Q3")
    )
    return wide.select("p_partkey", first_present({1: "Q1", 2: "Q2", 3: "Q3"}).alias("block"))


@query("K1", "SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place FROM nation")
def mixed_sort(spark, d):
    n = table(spark, d, "nation", "n_name", "n_regionkey")
    ordered = n.withColumn("k", -F.col("n_regionkey"))
    return ranking.running_id(ordered, ["k", "n_name"], "place").orderBy(F.desc("n_regionkey"), F.asc("n_name")).drop("k")


@query("K2", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS t,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, t::INTEGER AS rank, 'top' AS side FROM n WHERE n >= 10 AND t <= 5
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, b::INTEGER, 'bottom' FROM n WHERE n >= 10 AND b <= 5
""")
def extremes_by_group(spark, d):
    return ranking.extremes(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("K4", "SELECT l_suppkey, max(l_extendedprice) AS price, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def largest_in_group(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_extendedprice")
    return li.groupBy("l_suppkey").agg(
        F.max("l_extendedprice").alias("price"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey")
    )


@query("K5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_rows(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("K6", "SELECT event_id, value FROM events ORDER BY md5(event_id::VARCHAR || '/42'), event_id LIMIT 5000")
def hashed_sample_rows(spark, d):
    return ranking.hashed_sample(table(spark, d, "events", "event_id", "value"), "event_id", 5000)


@query("A5 O8", """
SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9 FROM lineitem GROUP BY 1
""")
def quantiles_by_part(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_extendedprice")
    q = exact_quantiles(li, ["l_partkey"], "l_extendedprice", {"q1": 0.25, "q9": 0.9})
    return q.select("l_partkey", F.round("q1", 4).alias("q1"), F.round("q9", 4).alias("q9"))


@query("W4", """
WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_quantity, n, sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_quantity)::BIGINT AS upto, sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS upto_total FROM c
""")
def running_counts(spark, d):
    counted = table(spark, d, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return running_total(counted, ["l_suppkey"], "l_quantity", "n", "upto")


@query("O15 A19", """
SELECT l_partkey AS image_id, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_extendedprice)) AS poi, arg_min(year(l_shipdate), (l_orderkey, l_linenumber, l_extendedprice))::INTEGER AS image_year
FROM lineitem GROUP BY 1 HAVING arg_min(year(l_shipdate), (l_orderkey, l_linenumber, l_extendedprice)) >= 1998
""")
def image_prefilter(spark, d):
    li = table(
        spark, d, "lineitem", F.col("l_partkey").alias("image_id"), F.col("l_suppkey").alias("poi"), F.year("l_shipdate").alias("image_year"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    return prefilter_images(li, ["l_orderkey", "l_linenumber", "l_extendedprice"], 1998).select("image_id", "poi", "image_year")


@query("O16 F33", """
SELECT l_suppkey, round(sum(0.4 * coalesce(a, 0) + 0.3 * b + 0.2 * l_discount + 0.1 * l_tax), 4) AS score, round(sum(0.45 * b + 0.30 * l_discount + 0.05 * l_tax - 0.30 * l_quantity), 4) AS mix
FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_quantity / 50 END AS a, l_linenumber / 7 AS b FROM lineitem) GROUP BY 1
""")
def composite_scores(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_discount", "l_tax", "l_quantity", "l_returnflag", (F.col("l_linenumber") / 7).alias("diversity"))
    li = li.withColumns({
        "recency": F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 50), "balance": F.col("l_discount"), "panorama": F.col("l_tax"),
        "mix": composite({"diversity": 0.45, "l_discount": 0.30, "l_tax": 0.05, "l_quantity": -0.30}),
    })
    return composite_score(li).groupBy("l_suppkey").agg(F.round(F.sum("composite_score"), 4).alias("score"), F.round(F.sum("mix"), 4).alias("mix"))

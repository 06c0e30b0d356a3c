"""Headers, filters and joins."""

from pyspark.sql import functions as F

from tripweave.functions.numeric import clip, within_or_null
from tripweave.operators import columns, filters, lookup
from tripweave.operators.allocation import allocate
from tripweave.operators.reshape import key_difference, key_intersection
from tripweave.queries.registry import query
from tripweave.session import cut_lineage
from tripweave.tables import table


@query("P1 P2 P3 P4 P5", "SELECT n_nationkey AS zone_no, n_name AS zone_name, n_regionkey AS area FROM nation")
def standard_headers(spark, d):
    raw = table(spark, d, "nation").toDF(" N_NATIONKEY", "N_Name ", " Area_Code ")
    clean = columns.normalise_headers(raw)
    clean = columns.coalesce_names(clean, {"zone_name": ["name", "n_name"], "area": ["region", "area_code"]})
    clean = columns.rename_map(clean, {"area": "area"}, first="zone_no")
    clean = columns.require_columns(clean, ["zone_no", "zone_name"])
    return columns.select_existing(clean, ["zone_no", "zone_name", "population", "area"])


@query("P6", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey = 3 OR c_mktsegment <> 'BUILDING'")
def totals_dropped(spark, d):
    segment = F.when(F.col("c_nationkey") != 3, F.concat(F.col("c_mktsegment"), F.lit(" ")))
    c = table(spark, d, "customer", "c_custkey", segment.alias("segment"))
    return filters.drop_equal_text(c, "segment", "Building").withColumn("segment", F.trim("segment"))


@query("P7 P8 P9", """
SELECT o_orderkey, o_totalprice AS x FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice BETWEEN 100000 AND 300000
""")
def usable_rows(spark, d):
    flag = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", " True").otherwise("0")
    code = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " ok").when(F.col("o_orderpriority") == "2-HIGH", "")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "HTTP_404")
    )
    x = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    o = table(spark, d, "orders", "o_orderkey", flag.alias("flag"), code.alias("code"), x.alias("x"))
    o = o.dropna("all", subset=["flag", "code"]).dropna(subset=["x"])
    o = o.filter(filters.is_true_text(F.col("flag")) & filters.is_clear_status(F.col("code")))
    return filters.keep_non_negative(o.filter(F.col("x").between(100000, 300000)), "x").select("o_orderkey", "x")


@query("P10", """
SELECT p_partkey, p_type AS subtype FROM part
WHERE CASE p_type WHEN 'SMALL' THEN p_brand = 'Brand#1' OR p_size IN (5, 6) WHEN 'LARGE' THEN p_brand IN ('Brand#2', 'Brand#3') ELSE TRUE END
""")
def category_rules(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_type", "p_brand", F.col("p_size").cast("string").alias("size"))
    rules = {"small": {"shop": ["Brand#1"], "building": ["5", "6"]}, "large": {"shop": ["Brand#2", "Brand#3"]}}
    keep = filters.category_match(F.col("p_type"), {"shop": F.col("p_brand"), "building": F.col("size")}, rules)
    return p.filter(keep).select("p_partkey", F.col("p_type").alias("subtype"))


@query("P11", """
WITH r AS (SELECT count(*) AS a, count(*) FILTER (event_type <> 'error') AS b, count(*) FILTER (event_type <> 'error' AND value > 30) AS c,
  count(*) FILTER (event_type <> 'error' AND value > 30 AND user_id % 4 = 1) AS e FROM events)
SELECT 0 AS step, 'all' AS rule, a AS kept FROM r UNION ALL SELECT 1, 'finished', b FROM r
UNION ALL SELECT 2, 'duration', c FROM r UNION ALL SELECT 3, 'attention', e FROM r
""")
def screening_attrition(spark, d):
    ev = table(spark, d, "events", "event_type", "value", "user_id")
    return filters.screen(ev, {
        "finished": F.col("event_type") != "error", "duration": F.col("value") > 30, "attention": F.col("user_id") % 4 == 1
    })[1]


@query("P12 P13", """
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS rating, greatest(least(c_acctbal, 8000.0), 100.0) AS clipped
FROM customer
""")
def valid_and_clipped(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return c.select(
        "c_custkey", within_or_null(F.col("c_acctbal"), 0, 5000).alias("rating"), clip(F.col("c_acctbal"), 100.0, 8000.0).alias("clipped")
    )


@query("P14", """
WITH x AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 <> 0 THEN s_acctbal END AS a, CASE WHEN s_nationkey % 3 <> 0 THEN 1 END AS b FROM supplier)
SELECT s_suppkey, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM x)), 6) AS a, coalesce(b, 0) AS b FROM x
""")
def filled_gaps(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    gaps = s.select(
        "s_suppkey", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_nationkey") % 3 != 0, 1).alias("b")
    )
    return columns.fill_with_median(gaps.fillna(0, ["b"]), "a").withColumn("a", F.round("a", 6))


@query("P15", """
SELECT CASE WHEN c_nationkey = 0 THEN 'missing_centroid' WHEN c_nationkey = 1 THEN 'invalid_centroid'
  WHEN NOT (1 + c_acctbal / 10000 BETWEEN 1.0 AND 1.7) THEN 'out_of_range' ELSE 'kept' END AS reason, count(*) AS n
FROM customer GROUP BY 1
""")
def reject_reasons(spark, d):
    shown = F.when(F.col("c_nationkey") == 1, "north").when(F.col("c_nationkey") > 1, (1 + F.col("c_acctbal") / 10000).cast("string"))
    c = table(spark, d, "customer", "c_custkey", shown.alias("lat"))
    value = F.col("lat").try_cast("double")
    marked = filters.reject_reasons(c, {
        "missing_centroid": F.col("lat").isNull(), "invalid_centroid": value.isNull(), "out_of_range": ~value.between(1.0, 1.7),
    })
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ joins


@query("J1 J2", """
SELECT o_orderkey, c_mktsegment AS segment, n_name AS area FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def attribute_lookup(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    n = table(spark, d, "nation", "n_nationkey", F.col("n_name").alias("area"))
    joined = lookup.left_lookup(o, c, {"o_custkey": "c_custkey"}, ["segment", "c_nationkey"])
    return lookup.left_lookup(joined, n, {"c_nationkey": "n_nationkey"}, ["area"]).select("o_orderkey", "segment", "area")


@query("J3 J4 F26", """
WITH od AS (SELECT o_custkey, l_suppkey, avg(l_quantity) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
car AS (SELECT o_custkey, l_suppkey, avg(l_extendedprice) AS car_cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
both_tables AS (SELECT od.*, car_cost FROM od LEFT JOIN car USING (o_custkey, l_suppkey))
SELECT a.l_suppkey, count(*) AS pairs, count(car_cost) AS with_car, round(avg(a.cost), 6) AS cost_left, round(avg(b.cost), 6) AS cost_right
FROM both_tables a JOIN (SELECT l_suppkey, avg(cost) AS cost FROM od GROUP BY 1) b ON a.l_suppkey = b.l_suppkey GROUP BY 1
""")
def two_key_lookup(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    trips = li.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    od = cut_lineage(trips.groupBy("o_custkey", "l_suppkey").agg(
        F.avg("l_quantity").alias("cost"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("car")
    ))  # read three times below
    car = od.filter("car IS NOT NULL").select("o_custkey", "l_suppkey", F.col("car").alias("car_cost"))
    both = od.drop("car").join(car, ["o_custkey", "l_suppkey"], "left")
    per = od.groupBy("l_suppkey").agg(F.avg("cost").alias("cost"))
    return lookup.inner_suffixed(both, per, ["l_suppkey"]).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("car_cost").alias("with_car"),
        F.round(F.avg("cost_left"), 6).alias("cost_left"), F.round(F.avg("cost_right"), 6).alias("cost_right"),
    )


@query("J5 S16", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 END AS weight FROM orders
""")
def literal_lookup(spark, d):
    weights = lookup.literal_table(spark, [("1-URGENT", 4), ("2-HIGH", 3), ("3-MEDIUM", 2)], "priority string, weight int")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return lookup.left_lookup(o, weights, {"o_orderpriority": "priority"}, ["weight"]).select("o_orderkey", "weight")


@query("J6 W1 W2", """
WITH listed AS (SELECT n_name AS area, n_regionkey * 1000.0::DOUBLE + 500 AS total FROM nation WHERE n_nationkey < 10
  UNION ALL SELECT 'Others', 777.0::DOUBLE),
k AS (SELECT c_custkey, n_name, greatest(c_acctbal, 0) AS pop, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'Others' END AS match_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, match_key, round_even(total * CASE WHEN sum(pop) OVER (PARTITION BY match_key) > 0 THEN pop / sum(pop) OVER (PARTITION BY match_key) ELSE 0 END, 4) AS total
FROM k JOIN listed ON match_key = area
""")
def allocation_with_fallback(spark, d):
    n = table(spark, d, "nation")
    listed = n.filter("n_nationkey < 10").select(F.col("n_name").alias("area"), (F.col("n_regionkey") * 1000.0 + 500).alias("total"))
    listed = listed.unionByName(spark.createDataFrame([("Others", 777.0)], "area string, total double"))
    people = table(spark, d, "customer", "c_custkey", "c_nationkey", F.greatest("c_acctbal", F.lit(0.0)).alias("pop")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey")
    )
    keyed = lookup.fallback_key(people, "n_name", listed, "area")
    joined = keyed.join(listed, F.col("match_key") == F.col("area"))
    return allocate(joined, "match_key", "pop", ["total"]).select("c_custkey", "match_key", "total")


@query("W2", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice,
  o_totalprice * (l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)) AS share
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def proportional_allocation(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    o = table(spark, d, "orders", "o_orderkey", F.col("o_totalprice").alias("share"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    shared = allocate(joined, "l_orderkey", "l_quantity", ["share"], None)
    return shared.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "share")


@query("J7 J8 U3", """
SELECT 'bought' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'not bought', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'only first', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def key_sets(spark, d):
    o = table(spark, d, "orders", F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer", F.col("c_custkey").alias("k"))
    done, urgent = o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'")
    parts = {
        "bought": lookup.keep_listed(c, done, ["k"]), "not bought": lookup.drop_listed(c, done, ["k"]),
        "only first": key_difference(done, urgent, ["k"]), "both": key_intersection(done, urgent, ["k"]),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("J9", """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1)
SELECT c_custkey AS user_id FROM customer LEFT JOIN last ON c_custkey = user_id WHERE state IS NULL OR state <> 'purchase'
""")
def unfinished_work(spark, d):
    work = table(spark, d, "customer", F.col("c_custkey").alias("user_id"))
    log = table(spark, d, "events", "user_id", "event_id", "event_type")
    return lookup.still_to_do(work, log, "user_id", "event_id", "event_type", "purchase")


@query("J10", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_totalprice > 400000)
""")
def incomplete_work(spark, d):
    work = table(spark, d, "customer", "c_custkey")
    done = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when((F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") > 400000), 1).alias("a"),
        F.when(F.col("o_orderstatus") != "P", 1).alias("b"),
    )
    return lookup.still_incomplete(work, done, "c_custkey", ["a", "b"])


@query("J15", """
SELECT n_nationkey, s_suppkey, round(n_nationkey + s_acctbal / 1000, 6) AS probe_cost FROM nation, supplier
""")
def probe_pairs(spark, d):
    probes = table(spark, d, "nation", "n_nationkey")
    pairs = lookup.probe_all(table(spark, d, "supplier", "s_suppkey", "s_acctbal"), probes)
    return pairs.select("n_nationkey", "s_suppkey", F.round(F.col("n_nationkey") + F.col("s_acctbal") / 1000, 6).alias("probe_cost"))


@query("J17 A11", """
WITH p AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer WHERE c_nationkey < 20 GROUP BY 1, 2),
g AS (SELECT c_nationkey AS nation, avg(m) AS prior FROM p GROUP BY 1)
SELECT s_suppkey, round(coalesce(prior, (SELECT avg(prior) FROM g)), 6) AS prior FROM supplier LEFT JOIN g ON s_nationkey = nation
""")
def prior_with_fallback(spark, d):
    from tripweave.operators.aggregates import mean_of_means

    c = table(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").filter("c_nationkey < 20")
    priors = mean_of_means(c, ["c_mktsegment"], ["c_nationkey"], "c_acctbal", "value").withColumnRenamed("c_nationkey", "s_nationkey")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    return lookup.group_prior(s, priors, "s_nationkey", "value", "prior").select("s_suppkey", F.round("prior", 6).alias("prior"))


@query("J19", """
SELECT p_partkey, coalesce(d.area, p_retailprice) AS area, coalesce(d.kind, p_type) AS kind FROM part
LEFT JOIN (SELECT l_partkey, max(CASE WHEN l_discount = 0.1 THEN l_quantity END) AS area, max(CASE WHEN l_discount = 0.1 AND l_linenumber > 6 THEN 'manual' END) AS kind FROM lineitem GROUP BY 1) d ON p_partkey = l_partkey
""")
def applied_decisions(spark, d):
    p = table(spark, d, "part", "p_partkey", F.col("p_retailprice").alias("area"), F.col("p_type").alias("kind"))
    decisions = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_linenumber", "l_discount")
    decided = F.col("l_discount") == 0.1
    decisions = decisions.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max(F.when(decided, F.col("l_quantity"))).alias("area"), F.max(F.when(decided & (F.col("l_linenumber") > 6), "manual")).alias("kind")
    )
    return lookup.apply_decisions(p, decisions, "p_partkey", ["area", "kind"])



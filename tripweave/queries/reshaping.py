"""Appending, pivoting, attribute records and address lookups."""

from pyspark.sql import functions as F

from tripweave.operators import reshape
from tripweave.operators.lookup import sector_lookup
from tripweave.queries.registry import query
from tripweave.tables import table


@query("U1 U2", """
SELECT kind, count(*) AS n, count(balance) AS balances, count(segment) AS segments, count(price) AS prices FROM (
  SELECT 'customer' AS kind, c_acctbal AS balance, c_mktsegment AS segment, NULL::DOUBLE AS price FROM customer
  UNION ALL SELECT 'supplier', s_acctbal, NULL, NULL FROM supplier UNION ALL SELECT 'part', NULL, NULL, p_retailprice FROM part)
GROUP BY 1
""")
def appended_tables(spark, d):
    c = table(spark, d, "customer", F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier", F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    p = table(spark, d, "part", F.lit("part").alias("kind"), F.col("p_retailprice").alias("price"))
    return reshape.append_all(c, s, p).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("balance").alias("balances"), F.count("segment").alias("segments"), F.count("price").alias("prices")
    )


@query("U4", """
SELECT l_orderkey, l_linenumber, item, dim, round(sum(v), 4) AS v FROM (
  SELECT l_orderkey, l_linenumber, 1 AS item, 'quantity' AS dim, l_quantity AS v FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, 'tax', l_tax FROM lineitem)
WHERE l_linenumber = 1 OR l_linenumber > 1 GROUP BY 1, 2, 3, 4
""")
def wide_to_long(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    long = reshape.wide_to_long(
        li, ["l_orderkey", "l_linenumber"], {"l_quantity": (1, "quantity"), "l_discount": (2, "discount"), "l_tax": (2, "tax")}, ["item", "dim"], "v"
    )
    return long.groupBy("l_orderkey", "l_linenumber", "item", "dim").agg(F.round(F.sum("v"), 4).alias("v"))


@query("U6", """
WITH w AS (SELECT user_id, coalesce(max(value) FILTER (event_type = 'click'), 0) AS alt_click, coalesce(max(value) FILTER (event_type = 'view'), 0) AS alt_view,
  coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS alt_purchase FROM events GROUP BY 1)
SELECT *, CASE WHEN alt_click >= alt_view AND alt_click >= alt_purchase THEN 0 WHEN alt_view >= alt_purchase THEN 1 ELSE 2 END AS chosen FROM w
""")
def long_to_wide(spark, d):
    ev = table(spark, d, "events", "user_id", "event_type", "value")
    wide = reshape.long_to_wide(ev, "user_id", "event_type", ["click", "view", "purchase"], "value", fill=0.0)
    return reshape.chosen_position(wide, ["alt_click", "alt_view", "alt_purchase"], "chosen")


@query("U7 F5", """
SELECT 'HC_' || sha256('=' || s_name || '|=' || s_acctbal_text) AS poi_id, s_name AS name, 'community retail' AS category, 'hawker centre' AS subtype, 1 AS has_foodcourt, 0 AS heritage_flag
FROM (SELECT s_name, s_suppkey::VARCHAR AS s_acctbal_text FROM supplier)
UNION ALL
SELECT 'HS_' || sha256('=' || n_name || '|=' || n_nationkey::VARCHAR), n_name, 'leisure', 'historic_site', NULL, 1 FROM nation
UNION ALL
SELECT 'ML_' || sha256('=' || p_name || '|=' || p_partkey::VARCHAR), p_name, 'retail', 'mall', (p_size % 2)::INTEGER, 0 FROM part
""")
def attribute_records(spark, d):
    sources = {
        "HC": (table(spark, d, "supplier"), {"name": F.col("s_name"), "key": F.col("s_suppkey")},
               {"category": "community retail", "subtype": "hawker centre", "has_foodcourt": 1, "heritage_flag": 0}),
        "HS": (table(spark, d, "nation"), {"name": F.col("n_name"), "key": F.col("n_nationkey")},
               {"category": "leisure", "subtype": "historic_site", "heritage_flag": 1}),
    }
    mall = table(spark, d, "part")
    records = reshape.attribute_records(sources)
    from tripweave.functions.text import surrogate_key

    parts = reshape.with_constants(
        mall.select(surrogate_key("ML", F.col("p_name"), F.col("p_partkey").cast("string")).alias("poi_id"), F.col("p_name").alias("name"),
                    (F.col("p_size") % 2).alias("has_foodcourt")),
        {"category": "retail", "subtype": "mall", "heritage_flag": 0},
    )
    return reshape.append_all(records.drop("key"), parts).select("poi_id", "name", "category", "subtype", "has_foodcourt", "heritage_flag")


@query("O20 F2", """
WITH area AS (SELECT upper(n_name) AS area, round(avg(c_acctbal)) AS car_time, round_even(avg(c_acctbal) / 100, 2) AS car_cost FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT o_orderkey, lpad((o_orderkey % 30)::VARCHAR, 2, '0') AS sector, car_time, car_cost
FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30 LEFT JOIN area ON area = upper(n_name)
""")
def postal_lookup(spark, d):
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    stats = table(spark, d, "customer", "c_nationkey", "c_acctbal").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("area")).agg(
        F.round(F.avg("c_acctbal")).alias("car_time"), F.bround(F.avg("c_acctbal") / 100, 2).alias("car_cost")
    )
    sectors = n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("sector_area"))
    code = F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0")
    o = table(spark, d, "orders", "o_orderkey", F.concat(code, F.lit("1234")).alias("postal"))
    found = sector_lookup(o, "postal", sectors, "code", "sector_area", stats, "area", ["car_time", "car_cost"])
    return found.select("o_orderkey", "sector", "car_time", "car_cost")

"""Grouped summaries and quality reports."""

from pyspark.sql import functions as F

from tripweave.functions.dates import age_days, decay_weight
from tripweave.operators import aggregates as agg
from tripweave.operators import profiling as prof
from tripweave.operators.allocation import cumulative_counts, grouped_mean, grouped_median
from tripweave.operators.linear import cumulative_marks
from tripweave.operators.lookup import with_group_stats
from tripweave.operators.ranking import keep_first
from tripweave.queries.registry import query
from tripweave.tables import table

AS_OF = "2024-03-01"


@query("A1 A2", """
SELECT event_type, k AS band, count(*) AS count FROM (SELECT event_type, CASE WHEN value < 80 THEN floor(value / 20)::BIGINT END AS k FROM events)
WHERE k IS NOT NULL GROUP BY 1, 2
""")
def group_counts(spark, d):
    band = F.when(F.col("value") < 80, F.floor(F.col("value") / 20))
    return agg.counts_by(table(spark, d, "events", "event_type", band.alias("band")), ["event_type", "band"])


@query("A3 A4", """
SELECT 'Total Records' AS category, count(*) AS count FROM events
UNION ALL SELECT 'Views', count(*) FILTER (event_type = 'view') FROM events
UNION ALL SELECT 'Failures', count(*) FILTER (event_type LIKE '%err%') FROM events
UNION ALL SELECT 'Other: ' || event_type, count(*) FROM events WHERE event_type <> 'view' AND event_type NOT LIKE '%err%' GROUP BY event_type
""")
def status_metrics(spark, d):
    return agg.status_report(table(spark, d, "events", "event_type"), "event_type", {"Views": "view"}, {"Failures": "err"}, "Other: ")


@query("A5", """
SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  count(*) FILTER (l_discount = 0) AS n_condition, count(*) AS n_total
FROM lineitem GROUP BY 1
""")
def group_medians(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount")
    out = agg.group_summary(li, "l_suppkey", "l_extendedprice", F.col("l_discount") == 0)
    return out.select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "n_condition", "n_total")


@query("A6 A7 W1", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS mean_qty,
  sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total_qty
FROM lineitem
""")
def group_stats_on_rows(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_suppkey", "l_quantity")
    joined = with_group_stats(li, ["l_suppkey"], mean_qty=F.round(F.avg("l_quantity"), 6), total_qty=F.sum("l_quantity"))
    return joined.drop("l_suppkey", "l_quantity")


@query("A8 A9", f"""
WITH w AS (SELECT user_id, value, exp(-ln(2) / 30 * date_diff('day', ts::DATE, DATE '{AS_OF}')) AS w FROM events),
m AS (SELECT user_id, sum(w) AS weight_sum, sum(w) * sum(w) / sum(w * w) AS n_eff, sum(w * value) / sum(w) AS mean FROM w GROUP BY 1)
SELECT user_id, round(any_value(weight_sum), 6) AS weight_sum, round(any_value(n_eff), 6) AS n_eff, round(any_value(mean), 6) AS value_mean,
  round(sum(w * pow(value - mean, 2)) / sum(w), 4) AS value_var
FROM w JOIN m USING (user_id) GROUP BY 1
""")
def weighted_user_moments(spark, d):
    days = age_days(F.to_date("ts"), AS_OF)
    ev = table(spark, d, "events", "user_id", "value", decay_weight(days, 30).alias("w"))
    out = agg.weighted_moments(ev, ["user_id"], "w", ["value"])
    return out.select(
        "user_id", F.round("weight_sum", 6).alias("weight_sum"), F.round("n_eff", 6).alias("n_eff"),
        F.round("value_mean", 6).alias("value_mean"), F.round("value_var", 4).alias("value_var"),
    )


@query("A9", """
SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_r, min(l_quantity) AS lo, max(l_quantity) AS hi,
  quantile_cont(l_quantity, 0.5) AS median, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS first_price
FROM lineitem GROUP BY 1
""")
def group_bundle(spark, d):
    from tripweave.operators.quantiles import exact_quantiles

    li = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")
    base = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"), F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice")).alias("first_price"),
    )
    return base.join(exact_quantiles(li, ["l_partkey"], "l_quantity", {"median": 0.5}), "l_partkey")


@query("A10", """
SELECT l_suppkey, round(sum(greatest(l_discount, 1e-9) * l_extendedprice) / sum(greatest(l_discount, 1e-9)), 4) AS price FROM lineitem GROUP BY 1
""")
def floored_weights(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount")
    return agg.floored_average(li, ["l_suppkey"], "l_extendedprice", "l_discount", "price").withColumn("price", F.round("price", 4))


@query("A12 O18", """
WITH r AS (SELECT p_brand, count(*) AS total, count(*) FILTER (p_size > 20) AS matched, count(*) FILTER (p_size <= 20) AS no_match,
  avg((p_size > 20)::INTEGER) AS match_rate FROM part GROUP BY 1)
SELECT p_brand, round(match_rate, 6) AS match_rate, no_match, CASE WHEN match_rate < 0.3 THEN 'find another source' ELSE 'review by hand' END AS advice
FROM r WHERE match_rate < 0.6
""")
def match_rate_advice(spark, d):
    rates = prof.match_rates(table(spark, d, "part", "p_brand", "p_size"), "p_brand", F.col("p_size") > 20)
    return prof.low_rate_advice(rates, "p_brand", 0.6).withColumn("match_rate", F.round("match_rate", 6))


@query("A13", """
WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1),
f AS (SELECT *, greatest(q25 - 3 * (q75 - q25), 0) AS lo, q75 + 3 * (q75 - q25) AS hi FROM q)
SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(any_value(q25), 4) AS q25, round(any_value(median), 4) AS median, round(any_value(q75), 4) AS q75,
  count(*) FILTER (l_extendedprice < 2000) AS below_min, count(*) FILTER (l_extendedprice < 10000) AS below_typical,
  count(*) FILTER (l_extendedprice > 90000) AS above_typical, count(*) FILTER (l_extendedprice > 99000) AS above_max,
  count(*) FILTER (l_extendedprice < lo) AS low_outliers, count(*) FILTER (l_extendedprice > hi) AS high_outliers,
  round(any_value(lo), 4) AS iqr_lower, round(any_value(hi), 4) AS iqr_upper
FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1
""")
def distribution_by_group(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice")
    out = prof.group_distribution(li, "l_suppkey", "l_extendedprice", [F.lit(2000.0), F.lit(10000.0), F.lit(90000.0), F.lit(99000.0)])
    rounded = ["mean", "std", "q25", "median", "q75", "iqr_lower", "iqr_upper"]
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else c for c in out.columns])


@query("A14", """
WITH v AS (SELECT 'l_quantity' AS "column", l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'late_price', CASE WHEN l_returnflag <> 'N' THEN l_extendedprice * l_discount END FROM lineitem)
SELECT "column", count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(max(value), 4) AS max,
  round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis, count(*) FILTER (value IS NULL) AS null_count,
  round_even(avg((value IS NULL)::INTEGER) * 100, 2) AS null_pct,
  round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95
FROM v GROUP BY 1
""")
def column_profiles(spark, d):
    late = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") * F.col("l_discount"))
    li = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", late.alias("late_price"))
    out = prof.describe(li, ["l_quantity", "l_extendedprice", "late_price"], {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    rounded = ["mean", "std", "max", "skewness", "kurtosis", "p5", "p50", "p95"]
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else c for c in out.columns])


def gaps(spark, d):
    """Events with missing values by rule."""
    ev = table(spark, d, "events", "event_type", "value", "user_id")
    return ev.select(
        F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("user_id") % 20 != 0, F.col("user_id")).alias("b"), F.col("event_type").alias("c"),
    )


@query("A15 P14", """
WITH g AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (user_id % 20 = 0) AS b FROM events)
SELECT 'scores' AS column_group, 'a' AS "column", a AS missing_count, round_even(a * 100.0::DOUBLE / n, 2) AS missing_pct, 'double' AS data_type FROM g
UNION ALL SELECT 'keys', 'b', b, round_even(b * 100.0::DOUBLE / n, 2), 'bigint' FROM g
UNION ALL SELECT 'keys', 'c', 0, 0.0, 'string' FROM g
""")
def missing_by_column(spark, d):
    return prof.missing_report(gaps(spark, d), {"scores": ["a"], "keys": ["b", "c"]})


@query("A15", """
WITH g AS (SELECT avg((event_type = 'error')::INTEGER) AS a, avg((user_id % 20 = 0)::INTEGER) AS b FROM events)
SELECT 'complete' AS band, 1::BIGINT AS count UNION ALL SELECT 'up to 10 %', ((a <= 0.1)::INTEGER + (b <= 0.1)::INTEGER)::BIGINT FROM g
UNION ALL SELECT 'over 10 %', ((a > 0.1)::INTEGER + (b > 0.1)::INTEGER)::BIGINT FROM g
""")
def missing_banded(spark, d):
    return prof.missing_bands(prof.missing_report(gaps(spark, d)))


@query("A16 A18", """
WITH v AS (SELECT 'l_discount' AS "column", l_discount AS value FROM lineitem UNION ALL SELECT 'mostly_zero', CASE WHEN l_quantity > 45 THEN l_tax ELSE 0 END FROM lineitem
  UNION ALL SELECT 'late', CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END FROM lineitem),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT "column", sum(n) FILTER (value = 0) / sum(n) AS z, max(n) / sum(n) AS t, count(*) AS n_unique FROM c GROUP BY 1),
w AS (SELECT "column", stddev_samp(value) AS sd FROM v GROUP BY 1)
SELECT "column", round(coalesce(z, 0), 6) AS zero_share, round(t, 6) AS top_share, round(sd, 6) AS std, n_unique,
  concat_ws(' | ', CASE WHEN z > 0.8 THEN 'HIGH-ZERO' END, CASE WHEN t > 0.95 THEN 'NEAR-CONST' END, CASE WHEN sd < 0.01 THEN 'LOW-STD' END, CASE WHEN n_unique <= 2 THEN 'BINARY' END) AS flags
FROM s JOIN w USING ("column")
""")
def information_content(spark, d):
    li = table(spark, d, "lineitem", "l_discount", "l_quantity", "l_tax", "l_linestatus").select(
        "l_discount", F.when(F.col("l_quantity") > 45, F.col("l_tax")).otherwise(0.0).alias("mostly_zero"),
        (F.col("l_linestatus") == "F").cast("int").alias("late"),
    )
    out = prof.information_check(li, li.columns)
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("zero_share", "top_share", "std")], "n_unique", "flags")


@query("A17", """
WITH v AS (SELECT 'disc' AS "column", l_discount * 12 AS value FROM lineitem UNION ALL SELECT 'tax', l_tax - 0.02 FROM lineitem)
SELECT "column", round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg((value > 1)::INTEGER), 6) AS share_above,
  round(avg((value < 0)::INTEGER), 6) AS share_below, avg((value > 1)::INTEGER) + avg((value < 0)::INTEGER) = 0 AS in_range
FROM v GROUP BY 1
""")
def scale_ranges(spark, d):
    li = table(spark, d, "lineitem", (F.col("l_discount") * 12).alias("disc"), (F.col("l_tax") - 0.02).alias("tax"))
    out = prof.range_check(li, ["disc", "tax"])
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("min", "max", "share_above", "share_below")], "in_range")


@query("A18", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT props) AS props, count(DISTINCT (user_id, event_type)) AS pairs FROM events")
def distinct_counts(spark, d):
    ev = table(spark, d, "events", "user_id", "props", "event_type")
    return ev.agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"), F.count_distinct(F.struct("user_id", "event_type")).alias("pairs")
    )


@query("A19 I4", """
SELECT user_id, event_type, min(event_id) AS first_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2
""")
def keep_first_and_last(spark, d):
    ev = table(spark, d, "events", "user_id", "event_type", "event_id", "value")
    first = keep_first(ev, ["user_id", "event_type"], ["event_id"]).withColumnsRenamed({"event_id": "first_id", "value": "first_value"})
    last = keep_first(ev, ["user_id", "event_type"], ["event_id"], last=True).select("user_id", "event_type", F.col("value").alias("last_value"))
    return first.join(last, ["user_id", "event_type"])


def size_band():
    """Class of ten sizes."""
    return F.floor(F.col("p_size") / 10).cast("int")


@query("A20", """
SELECT p_brand, round_even(sum(CASE WHEN b > 0 THEN n * (b * 10 + 5) END) / sum(n) FILTER (b > 0), 2) AS mean_size
FROM (SELECT p_brand, p_size // 10 AS b, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1
""")
def grouped_means(spark, d):
    p = table(spark, d, "part", "p_brand", "p_size")
    wide = p.groupBy("p_brand").agg(*[F.count_if(size_band() == b).cast("double").alias(f"b{b}") for b in range(6)])
    return wide.select("p_brand", grouped_mean({f"b{b}": b * 10 + 5 for b in range(1, 6)}).alias("mean_size"))


@query("A21 W3", """
WITH c AS (SELECT p_brand, p_size // 10 AS b, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY b) AS cum, sum(n) OVER (PARTITION BY p_brand) AS total FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY b) AS k FROM r WHERE cum >= total / 2)
SELECT p_brand, CASE WHEN b < 3 THEN round_even(b * 10 + (total / 2 - (cum - n)) / n * 10, 2) END AS median, b >= 3 AS median_open FROM m WHERE k = 1
""")
def grouped_medians(spark, d):
    p = table(spark, d, "part", "p_brand", size_band().alias("b"))
    counts = p.groupBy("p_brand", "b").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"lower": F.col("b") * 10.0, "width": F.lit(10.0), "is_open": F.col("b") >= 3}
    )
    return grouped_median(counts, ["p_brand"], "b", "lower", "width", "n", "is_open")


@query("W3", """
WITH c AS (SELECT p_type, p_size // 5 AS b, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, b, n, sum(n) OVER (PARTITION BY p_type ORDER BY b)::BIGINT AS cum_n, sum(n) OVER (PARTITION BY p_type)::BIGINT AS total_n FROM c
""")
def cumulative_classes(spark, d):
    p = table(spark, d, "part", "p_type", F.floor(F.col("p_size") / 5).cast("int").alias("b"))
    return cumulative_counts(p.groupBy("p_type", "b").agg(F.count(F.lit(1)).alias("n")), ["p_type"], "b", "n")


@query("W4", """
WITH s AS (SELECT p_size, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS share FROM part GROUP BY 1),
c AS (SELECT p_size, sum(share) OVER (ORDER BY p_size) AS cum FROM s)
SELECT min(p_size) FILTER (cum >= 0.8) AS n80, min(p_size) FILTER (cum >= 0.9) AS n90, min(p_size) FILTER (cum >= 0.95) AS n95 FROM c
""")
def first_crossings(spark, d):
    p = table(spark, d, "part", "p_size", "p_retailprice")
    shares = with_group_stats(p.groupBy("p_size").agg(F.sum("p_retailprice").alias("v")), [], t=F.sum("v"))
    return cumulative_marks(shares.withColumn("share", F.col("v") / F.col("t")), "p_size", "share", {"n80": 0.8, "n90": 0.9, "n95": 0.95})


@query("A22", """
WITH s AS (SELECT count(*)::DOUBLE AS n, round(avg(o_totalprice), 2) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi, (count(*) FILTER (o_totalprice > 400000))::DOUBLE AS big FROM orders)
SELECT 'Number' AS statistic, n AS value FROM s UNION ALL SELECT 'Mean', m FROM s UNION ALL SELECT 'Minimum', lo FROM s
UNION ALL SELECT 'Maximum', hi FROM s UNION ALL SELECT 'Over limit', big FROM s
""")
def summary_rows(spark, d):
    price = F.col("o_totalprice")
    return agg.metric_rows(table(spark, d, "orders", "o_totalprice"), {
        "Number": F.count(price), "Mean": F.round(F.avg(price), 2), "Minimum": F.min(price), "Maximum": F.max(price),
        "Over limit": F.count_if(price > 400000),
    }, "statistic", "value")


@query("A23", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(least(greatest(-sum(p * ln(p)) / ln(5), 0), 1), 6) AS entropy FROM p GROUP BY 1
""")
def activity_entropy(spark, d):
    ev = table(spark, d, "events", "user_id", "event_type")
    return agg.category_entropy(ev, "user_id", "event_type", 5, "entropy").withColumn("entropy", F.round("entropy", 6))


@query("A37", """
SELECT 'zero' AS "check", (count(*) FILTER (l_discount = 0))::DOUBLE AS value, round_even(count(*) FILTER (l_discount = 0) / count(*), 4) AS pct,
  CASE WHEN count(*) FILTER (l_discount = 0) < 100 THEN 'OK' ELSE 'WARN' END AS flag, 'lines without discount' AS note FROM lineitem
UNION ALL SELECT 'mean_quantity', round_even(avg(l_quantity), 4), NULL, CASE WHEN avg(l_quantity) > 20 THEN 'OK' ELSE 'WARN' END, 'average quantity' FROM lineitem
""")
def quality_log_rows(spark, d):
    li = table(spark, d, "lineitem", "l_discount", "l_quantity")
    zero = F.count_if(F.col("l_discount") == 0)
    a = agg.quality_row(li, "zero", zero, F.bround(zero / F.count(F.lit(1)), 4), F.when(zero < 100, "OK").otherwise("WARN"), "lines without discount")
    mean = F.avg("l_quantity")
    b = agg.quality_row(li, "mean_quantity", F.bround(mean, 4), None, F.when(mean > 20, "OK").otherwise("WARN"), "average quantity")
    return a.unionByName(b)


@query("A38", """
WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, avg(l_extendedprice) AS m2 FROM lineitem GROUP BY 1),
t AS (SELECT avg(l_quantity) AS a, var_pop(l_quantity) * count(*) AS st, avg(l_extendedprice) AS a2, var_pop(l_extendedprice) * count(*) AS st2, count(*) AS n FROM lineitem)
SELECT 'l_quantity' AS variable, round((SELECT sum(g.n * pow(m - a, 2)) FROM g) / st, 6) AS r2, n FROM t
UNION ALL SELECT 'l_extendedprice', round((SELECT sum(g.n * pow(m2 - a2, 2)) FROM g) / st2, 6), n FROM t
""")
def variance_between_groups(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice")
    return agg.between_share(li, "l_suppkey", "l_quantity", "l_extendedprice").select("variable", F.round("r2", 6).alias("r2"), "n")


@query("A39", """
SELECT c_mktsegment, round(avg((n > 0)::INTEGER), 6) AS coverage_rate, round(avg(n) FILTER (n > 0), 6) AS avg_amount
FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1
""")
def coverage_rates(spark, d):
    counts = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n"])
    out = prof.coverage(c, ["c_mktsegment"], F.col("n") > 0, "n")
    return out.select("c_mktsegment", F.round("coverage_rate", 6).alias("coverage_rate"), F.round("avg_amount", 6).alias("avg_amount"))


@query("O11", """
WITH s AS (SELECT l_orderkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem),
t AS (SELECT l_orderkey, sum(p) AS p FROM s GROUP BY 1)
SELECT 'shares do not sum to 1' AS rule, count(*) FILTER (abs(p - 1) > 1e-6) AS count FROM t UNION ALL SELECT 'negative share', count(*) FILTER (p < 0) FROM t
""")
def invariant_rows(spark, d):
    li = with_group_stats(table(spark, d, "lineitem", "l_orderkey", "l_quantity"), ["l_orderkey"], t=F.sum("l_quantity"))
    per = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") / F.col("t")).alias("p"))
    return agg.violations(per, {"shares do not sum to 1": F.abs(F.col("p") - 1) > 1e-6, "negative share": F.col("p") < 0})


@query("O17", """
WITH a AS (SELECT count(*) FILTER (p_size > 0 AND p_size < 20) AS unit_issues, count(*) FILTER (p_type = 'PROMO' AND p_size * 1000 > 20000) AS buffer_conflicts FROM part)
SELECT unit_issues, (SELECT count(*) FROM part WHERE p_type = 'PROMO' AND p_size > 20000) AS buffer_conflicts,
  (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_type = 'SMALL') AS median_all,
  (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_type = 'SMALL' AND p_brand IN ('Brand#1', 'Brand#2')) AS median_core,
  (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_type = 'SMALL' AND p_brand IN ('Brand#1', 'Brand#2')) < 0.5 * (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_type = 'SMALL') AS core_smaller
FROM a
""")
def area_sanity(spark, d):
    method = F.when(F.col("p_type") == "PROMO", "point_Buffer").otherwise("pip_single")
    p = table(spark, d, "part", "p_size", "p_type", "p_brand", method.alias("match_type"))
    return prof.sanity_rules(p, "p_size", F.col("match_type"), F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_type") == "SMALL")


@query("O9", """
WITH h AS (SELECT quantile_cont(n, 0.99) AS hi FROM (SELECT count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey))
SELECT c_custkey, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) > (SELECT hi FROM h) THEN 'high_outlier' WHEN count(o_orderkey) BETWEEN 1 AND 10 THEN 'sparse'
  WHEN count(o_orderkey) = 0 THEN 'zero_excluded' ELSE 'valid' END AS n_flag
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def count_quality_flags(spark, d):
    from tripweave.plans.od_flow import with_count_flags

    counts = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer", "c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n"])
    return with_count_flags(c.select("c_custkey", "n"), "n")


@query("O19", """
SELECT 'net' AS "column", round(max(abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount))), 6) AS max_abs_diff, TRUE AS agrees FROM lineitem
UNION ALL SELECT 'gross', round(max(abs(l_extendedprice * l_tax)), 6), FALSE FROM lineitem
""")
def recomputed_columns(spark, d):
    li = table(spark, d, "lineitem", "l_extendedprice", "l_discount", "l_tax")
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    out = agg.compare_columns(li, {"net": (price * (1 - off), price - price * off), "gross": (price * (1 + tax), price)})
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 6))

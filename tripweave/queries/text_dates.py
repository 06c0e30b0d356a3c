"""Strings, keys and dates."""

from pyspark.sql import functions as F

from tripweave.functions import dates, text
from tripweave.operators.lookup import with_group_stats
from tripweave.queries.registry import query
from tripweave.tables import table

AS_OF = "2024-03-01"


@query("F1", """
SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (
  SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t
  FROM documents)
""")
def clean_names(spark, d):
    cleaned = table(spark, d, "documents", "doc_id", text.clean_name(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("F2", "SELECT c_custkey, upper(trim(c_mktsegment)) AS key_name FROM customer")
def normalised_keys(spark, d):
    raw = table(spark, d, "customer", "c_custkey", F.concat(F.lit("  "), F.initcap(F.lower("c_mktsegment")), F.lit(" ")).alias("k"))
    return raw.select("c_custkey", text.norm_key(F.col("k")).alias("key_name"))


@query("F3", """
SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN NULL ELSE o_totalprice END AS amount,
  CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0::DOUBLE END AS amount_or_zero
FROM orders
""")
def numbers_in_text(spark, d):
    shown = F.when(F.col("o_orderstatus") == "F", "-").when(F.col("o_orderstatus") == "O", "n.a.").otherwise(
        F.format_number("o_totalprice", 2)
    )
    raw = table(spark, d, "orders", "o_orderkey", shown.alias("shown"))
    return raw.select(
        "o_orderkey", text.parse_number(F.col("shown"), dash_is_zero=True).alias("amount"),
        text.parse_number(F.col("shown"), dash_is_zero=True, bad=0).alias("amount_or_zero"),
    )


@query("F4", """
SELECT c_custkey, c_acctbal AS lat, c_custkey / 8 AS lon, c_acctbal AS lat2, c_custkey / 8 AS lon2 FROM customer
""")
def latlon_in_text(spark, d):
    lat, lon = F.col("c_acctbal").cast("decimal(12,2)").cast("string"), (F.col("c_custkey") / 8).cast("decimal(20,3)").cast("string")
    raw = table(spark, d, "customer", "c_custkey", F.concat(lat, F.lit(","), lon).alias("a"), F.concat(F.lit("("), lat, F.lit(", "), lon, F.lit(")")).alias("b"))
    pairs = raw.select("c_custkey", text.parse_latlon(F.col("a")).alias("p"), text.parse_latlon(F.col("b")).alias("q"))
    return pairs.select("c_custkey", "p.lat", "p.lon", F.col("q.lat").alias("lat2"), F.col("q.lon").alias("lon2"))


@query("F5", """
SELECT s_suppkey, 'SP_' || sha256('=' || s_name || '|=' || s_nationkey::VARCHAR) AS place_id,
  'P_' || lpad(s_suppkey::VARCHAR, 7, '0') AS point_id
FROM supplier
""")
def surrogate_keys(spark, d):
    raw = table(spark, d, "supplier")
    return raw.select(
        "s_suppkey", text.surrogate_key("SP", F.col("s_name"), F.col("s_nationkey").cast("string")).alias("place_id"),
        text.padded_id("P", F.col("s_suppkey")).alias("point_id"),
    )


@query("F6", """
SELECT p_partkey, split_part(p_type || '_' || p_brand, '_', 1) AS kind, split_part(p_type || '_' || p_brand, '_', 2) AS brand
FROM part
""")
def key_parts(spark, d):
    joined = table(spark, d, "part", "p_partkey", F.concat_ws("_", "p_type", "p_brand").alias("k"))
    return joined.select("p_partkey", text.key_part(F.col("k"), 0).alias("kind"), text.key_part(F.col("k"), 1).alias("brand"))


@query("F7", "SELECT o_orderstatus, max(o_orderkey) AS last_number FROM orders GROUP BY 1")
def resume_numbers(spark, d):
    ids = table(spark, d, "orders", "o_orderstatus", text.padded_id("MP", F.col("o_orderkey")).alias("id"))
    return ids.groupBy("o_orderstatus").agg(F.max(text.numeric_suffix(F.col("id"), "MP")).alias("last_number"))


@query("F36", """
SELECT p_partkey, CASE WHEN p_size <= 20 AND p_size % 3 <> 0 THEN 'no tags' ELSE
  concat_ws(' | ', CASE WHEN p_size > 20 THEN 'building=' || p_type END, CASE WHEN p_size % 3 = 0 THEN 'shop=' || p_brand END)
  END AS tags
FROM part
""")
def tag_text(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_size")
    tags = text.format_tags(
        building=F.when(F.col("p_size") > 20, F.col("p_type")), shop=F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    )
    return p.select("p_partkey", tags.alias("tags"))


@query("F37", """
WITH p AS (SELECT p_partkey, p_name, min(p_name) OVER (PARTITION BY p_brand) AS lead FROM part),
w AS (SELECT DISTINCT p_name, lead, list_filter(string_split(lower(p_name), ' '), lambda w: w <> '') AS x, list_filter(string_split(lower(lead), ' '), lambda w: w <> '') AS y FROM p),
s AS (SELECT p_name, lead, array_to_string(list_sort(list_distinct(list_filter(x, lambda w: list_contains(y, w)))), ' ') AS sh,
  array_to_string(list_sort(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))), ' ') AS a, array_to_string(list_sort(list_distinct(list_filter(y, lambda w: NOT list_contains(x, w)))), ' ') AS b FROM w),
m AS (SELECT *, list_transform(string_split(b, ''), lambda v: list_transform(string_split(a, ''), lambda u: (u = v)::BIGINT)) AS same FROM s),
l AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 ELSE list_max(list_reduce(list_concat([list_transform(same[1], lambda z: 0::BIGINT)], same), lambda row, hit:
  list_transform(range(1, len(row) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda k: CASE WHEN hit[k] = 1 THEN coalesce(row[k - 1], 0) + 1 ELSE row[k] END))))) END AS c,
  length(sh) AS n, (sh <> '')::INT AS gap, length(a) AS la, length(b) AS lb FROM m),
t AS (SELECT p_name, lead, CASE WHEN sh <> '' AND (a = '' OR b = '') THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * greatest(1 - (la + lb - 2 * c) / (2 * n + 2 * gap + la + lb),
  CASE WHEN sh = '' THEN 0 ELSE 1 - (gap + la) / (2 * n + gap + la) END, CASE WHEN sh = '' THEN 0 ELSE 1 - (gap + lb) / (2 * n + gap + lb) END) END AS score FROM l)
SELECT p_partkey, p_name, lead, round_even(score, 4) AS score FROM p JOIN t USING (p_name, lead)
""")
def name_similarity(spark, d):
    """Each part's name against the first name of its brand: one pair per part."""
    p = with_group_stats(table(spark, d, "part", "p_partkey", "p_brand", "p_name"), ["p_brand"], lead=F.min("p_name"))
    # identical pairs are scored once
    pairs = p.select("p_name", "lead").distinct().withColumn("score", F.bround(text.token_set_ratio(F.col("p_name"), F.col("lead")), 4))
    return p.join(pairs, ["p_name", "lead"]).select("p_partkey", "p_name", "lead", "score")


@query("F8", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate::DATE END AS day FROM orders
""")
def iso_dates(spark, d):
    shown = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09:30:00.125"))
    )
    return table(spark, d, "orders", "o_orderkey", shown.alias("s")).select("o_orderkey", dates.iso_date(F.col("s")).alias("day"))


@query("F9", """
SELECT event_id, year(ts)::INTEGER AS image_year, (2026 - year(ts))::INTEGER AS image_age FROM events
""")
def epoch_ages(spark, d):
    raw = table(spark, d, "events", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    when = dates.epoch_ms(F.col("ms"))
    return raw.select("event_id", F.year(when).alias("image_year"), dates.age_years(when, 2026).alias("image_age"))


@query("F10 F11 F12", f"""
SELECT event_id, age_days, round(exp(-ln(2) / 365 * age_days), 8) AS w_time,
  CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS w_view
FROM (SELECT *, date_diff('day', ts::DATE, DATE '{AS_OF}')::INTEGER AS age_days FROM events)
""")
def decay_weights(spark, d):
    raw = table(spark, d, "events", "event_id", "event_type", dates.age_days(F.to_date("ts"), AS_OF).alias("age_days"))
    flag = F.when(F.col("event_type") == "view", "true").otherwise("False")
    return raw.select(
        "event_id", "age_days", F.round(dates.decay_weight(F.col("age_days")), 8).alias("w_time"), dates.view_weight(flag).alias("w_view")
    )

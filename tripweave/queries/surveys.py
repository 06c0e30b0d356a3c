"""Survey tables: customers stand for respondents, their answers follow from their keys."""

from pyspark.sql import functions as F

from tripweave.operators import design as ds
from tripweave.operators import survey as sv
from tripweave.operators.choice_models import choice_arrays
from tripweave.operators.reshape import wide_to_long
from tripweave.plans import survey as plan
from tripweave.queries.registry import query
from tripweave.tables import dealt, table

ANSWERS = {(b, t): f"Q3-{b}-{t}" for b in range(1, 5) for t in range(1, 9)}


def respondents(spark, d):
    """Wide answers: each customer fills one block of eight tasks; every fourth answer is missing."""
    cells = []
    for (b, t), name in ANSWERS.items():
        raw = "(c_custkey + c_nationkey) % 3 + 1" if t == 1 else f"(c_custkey * 7 + {t * 13} + c_nationkey) % 4"
        cells.append(f"CASE WHEN c_custkey % 4 = {b - 1} AND {raw} > 0 THEN string({raw} + {3 if b == 1 else 0}) END AS `{name}`")
    return dealt(table(spark, d, "customer", "c_custkey", "c_nationkey"), "c_custkey").selectExpr(
        "c_custkey AS person_id", "20D + c_custkey % 30 AS car_time", "3.25D + c_nationkey % 5 AS car_cost",
        "40D + c_custkey % 17 AS pt_time", "1.5D + c_nationkey % 3 AS pt_cost", *cells,
    )


def design_table(spark):
    """Attribute levels by rule: 4 blocks x 7 tasks x 2 alternatives."""
    n = F.col("id")
    rows = spark.range(56).select(
        (F.floor(n / 14) + 1).cast("int").alias("block"), (F.floor((n % 14) / 2) + 1).cast("int").alias("task"), (n % 2).cast("int").alias("a")
    )
    b, t, a = F.col("block"), F.col("task"), F.col("a")
    return rows.select(
        "block", "task", F.when(a == 0, "A").otherwise("B").alias("alt"), ((b * 5 + t * 3 + a) % 3).alias("scale_j"),
        ((b + t * 2 + a) % 5).alias("tt_level"), ((b * 2 + t + a) % 5).alias("cost_level"), ((b + t + a * 3) % 5).alias("transfer_level"),
    )


def choices(spark, d):
    return sv.choice_long(respondents(spark, d), ANSWERS, design_table(spark))


LONG = """
WITH p AS (SELECT c_custkey AS person_id, c_nationkey AS n, (c_custkey % 4 + 1)::INTEGER AS block, 20.0::DOUBLE + c_custkey % 30 AS ct, 3.25::DOUBLE + c_nationkey % 5 AS cc,
  40.0::DOUBLE + c_custkey % 17 AS pt, 1.5::DOUBLE + c_nationkey % 3 AS pc FROM customer),
r AS (SELECT p.*, t::INTEGER AS task, CASE WHEN t = 1 THEN (person_id + n) % 3 + 1 ELSE (person_id * 7 + t * 13 + n) % 4 END AS code, CASE WHEN t = 8 THEN 3 ELSE t END AS dt FROM p, range(1, 9) g(t)),
a AS (SELECT r.*, alt, alt_num::INTEGER AS alt_num, (block * 5 + dt * 3 + alt_num) % 3 AS sj, (block + dt * 2 + alt_num) % 5 AS tl, (block * 2 + dt + alt_num) % 5 AS cl, (block + dt + alt_num * 3) % 5 AS xl
  FROM r, (VALUES ('A', 0), ('B', 1), ('C', 2)) v(alt, alt_num) WHERE code > 0),
l AS (SELECT person_id, block, task, CASE task WHEN 7 THEN 'Extreme_VC' WHEN 8 THEN 'Test_Retest' ELSE 'Standard' END AS task_type, alt, alt_num, (code = alt_num + 1)::INTEGER AS chosen,
  CASE WHEN alt = 'C' THEN 0 ELSE ct + ([-4, 0, 5, 9, 14])[tl + 1] END AS car_time, CASE WHEN alt = 'C' THEN 0 ELSE cc + ([-1, 0, 1, 2, 4])[cl + 1] END AS car_cost,
  CASE WHEN alt = 'C' THEN 0 ELSE pt + ([-9, 0, 9, 17, 32])[tl + 1] END AS pt_time, CASE WHEN alt = 'C' THEN 0 ELSE pc + ([-1, 0, 0, 0, 1])[cl + 1] END AS pt_cost,
  CASE WHEN alt = 'C' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + ([-1, 0, 0, 0, 1])[xl + 1] END AS pt_transfer, CASE WHEN alt = 'C' THEN 0 ELSE sj END::INTEGER AS scale_j FROM a),
long AS (SELECT *, CASE WHEN alt = 'C' THEN 0 ELSE car_time + pt_time + (car_cost + pt_cost) / 0.20 + pt_transfer * 5 END AS gtc FROM l)
"""


@query("U5 J18 F18 F19 F25 W20", LONG + """
SELECT person_id, block, task, task_type, alt, alt_num, chosen, car_time, car_cost, pt_time, pt_cost, pt_transfer, (scale_j = 1)::INTEGER AS D_med, (scale_j = 2)::INTEGER AS D_lrg, round(gtc, 6) AS gtc FROM long
""")
def choice_table(spark, d):
    return choices(spark, d).withColumn("gtc", F.round("gtc", 6)).drop("obs_id", "scale_j")


@query("A31", LONG + """
, q AS (SELECT person_id, block, max(alt) FILTER (chosen = 1 AND task = 7) AS v, max(alt) FILTER (chosen = 1 AND task = 3) AS s, max(alt) FILTER (chosen = 1 AND task = 8) AS r FROM long GROUP BY 1, 2),
f AS (SELECT *, coalesce(v = 'A', FALSE)::INTEGER AS vc_pass, coalesce(s = r, FALSE)::INTEGER AS retest_match FROM q)
SELECT person_id, vc_pass, retest_match, CASE vc_pass + retest_match WHEN 0 THEN 'remove' WHEN 1 THEN 'flag' ELSE 'keep' END AS verdict FROM f
""")
def response_screening(spark, d):
    return sv.response_quality(choices(spark, d)).select("person_id", "vc_pass", "retest_match", "verdict")


QUALITY = LONG + """
, q AS (SELECT person_id, block, max(alt) FILTER (chosen = 1 AND task = 7) AS v, max(alt) FILTER (chosen = 1 AND task = 3) AS s, max(alt) FILTER (chosen = 1 AND task = 8) AS r FROM long GROUP BY 1, 2),
f AS (SELECT *, coalesce(v = 'A', FALSE)::INTEGER AS vc_pass, coalesce(s = r, FALSE)::INTEGER AS retest_match FROM q)
"""


@query("A31", QUALITY + """
SELECT count(*) AS n, sum(vc_pass)::BIGINT AS vc_passed, round(avg(vc_pass), 8) AS vc_rate, sum(retest_match)::BIGINT AS retest_matched, round(avg(retest_match), 8) AS retest_rate,
  count(*) FILTER (vc_pass + retest_match = 2) AS n_keep, count(*) FILTER (vc_pass + retest_match = 1) AS n_flag, count(*) FILTER (vc_pass + retest_match = 0) AS n_remove FROM f
""")
def response_pass_rates(spark, d):
    rates = sv.pass_rates(sv.response_quality(choices(spark, d)))
    return rates.withColumns({c: F.round(c, 8) for c in ("vc_rate", "retest_rate")})


@query("A31", QUALITY + "SELECT person_id FROM f GROUP BY 1 HAVING min(vc_pass) = 1")
def response_passers(spark, d):
    return sv.passers(sv.response_quality(choices(spark, d)))


@query("A30", LONG + ", c AS (SELECT alt, count(*) AS n FROM long WHERE chosen = 1 GROUP BY 1) SELECT alt, n, round(n / (SELECT sum(n) FROM c), 8) AS share FROM c")
def alternative_shares(spark, d):
    return sv.choice_shares(choices(spark, d)).withColumn("share", F.round("share", 8))


@query("W19 W16", LONG + """
SELECT person_id || '_' || block || '_' || task AS obs_id, count(DISTINCT alt_num) AS n_alts, sum(chosen)::BIGINT AS n_chosen FROM long WHERE NOT (person_id % 10 = 0 AND chosen = 1)
GROUP BY 1 HAVING count(DISTINCT alt_num) < 2 OR sum(chosen) <> 1
""")
def broken_observations(spark, d):
    """Every tenth person's chosen rows are lost first, so the check has something to find."""
    damaged = choices(spark, d).filter(~((F.col("person_id") % 10 == 0) & (F.col("chosen") == 1)))
    return sv.bad_observations(damaged, "obs_id")


@query("U6", LONG + """
SELECT person_id || '_' || block || '_' || task AS obs_id, round(max(gtc) FILTER (alt_num = 0), 6) AS x0, round(max(gtc) FILTER (alt_num = 1), 6) AS x1, max(alt_num) FILTER (chosen = 1) AS pos FROM long GROUP BY 1
""")
def choice_matrix(spark, d):
    arrays = choice_arrays(choices(spark, d), "obs_id", "alt_num", [0, 1, 2], {"gtc": ("gtc", [0, 1])})
    return arrays.select("obs_id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"), "pos")


def ratings(spark, d):
    """Twelve images rated 1-3 by each respondent, one cell in eleven missing."""
    key = F.col("c_custkey")
    c = dealt(table(spark, d, "customer", "c_custkey"), "c_custkey")
    def cell(i):
        same = F.pmod(key, F.lit(50)) == 0
        value = F.when(same, F.lit(2)).otherwise(F.pmod(key * (i + 3) + i * i, F.lit(3)) + 1)
        return F.when(same | (F.pmod(key + i, F.lit(11)) != 0), value)
    wide = c.select(F.col("c_custkey").alias("person_id"), *[cell(i).alias(f"Q4-{i}_1") for i in range(1, 13)])
    return wide_to_long(wide, ["person_id"], {f"Q4-{i}_1": (i, "liveliness") for i in range(1, 13)}, ["image", "dim"], "rating")


RATED = """
WITH r AS (SELECT c_custkey AS person_id, i::INTEGER AS image, CASE WHEN c_custkey % 50 = 0 THEN 2 WHEN (c_custkey + i) % 11 <> 0 THEN (c_custkey * (i + 3) + i * i) % 3 + 1 END::DOUBLE AS rating FROM customer, range(1, 13) g(i))
"""


@query("A28 U4", RATED + "SELECT person_id FROM r GROUP BY 1 HAVING count(rating) = 12 AND count(DISTINCT rating) = 1")
def straight_line_raters(spark, d):
    return sv.straight_liners(ratings(spark, d), "person_id", "rating", 12)


@query("A15 A29", RATED + "SELECT image, 'liveliness' AS dim, count(rating) AS n_valid, round_even(avg((rating IS NULL)::INTEGER) * 100, 1) AS missing_pct, round(avg(rating), 6) AS mean FROM r GROUP BY 1")
def rating_gaps(spark, d):
    r = ratings(spark, d)
    means = r.groupBy("image").agg(F.round(F.avg("rating"), 6).alias("mean"))
    return sv.rating_missing(r, "image", "dim", "rating").join(means, "image")


@query("A27 W9 F17", """
WITH i AS (SELECT c_custkey, 6 - ((c_custkey * 3) % 5 + 1) AS a, (c_custkey * 7 + c_nationkey) % 5 + 1 AS b, CASE WHEN c_nationkey <> 4 THEN (c_custkey + c_nationkey * 2) % 5 + 1 END AS e FROM customer),
m AS (SELECT c_custkey, (a + b + coalesce(e, 0)) / (2 + (e IS NOT NULL)::INTEGER) AS lv FROM i), s AS (SELECT avg(lv) AS m, stddev_pop(lv) AS sd FROM m)
SELECT c_custkey, round(lv, 6) AS lv, round((lv - m) / sd, 6) AS lv_z FROM m, s
""")
def attitude_scores(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        "c_custkey", (F.pmod(key * 3, F.lit(5)) + 1).cast("string").alias("i1"), (F.pmod(key * 7 + nation, F.lit(5)) + 1).cast("string").alias("i2"),
        F.when(nation != 4, F.pmod(key + nation * 2, F.lit(5)) + 1).cast("string").alias("i3"),
    )
    out = plan.attitudes(c, {"lv": ["i1", "i2", "i3"]}, reverse=["i1"])
    return out.select("c_custkey", F.round("lv", 6).alias("lv"), F.round("lv_z", 6).alias("lv_z"))


@query("P11 W17 F15 F16", """
WITH k AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 700 + 100 > 180 AND c_nationkey % 5 = 4)
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS person_id, ([24, 35, 45, 55, 65])[c_custkey % 6 + 1]::DOUBLE AS age_num,
  (c_custkey % 4 IN (1, 2))::INTEGER AS car_avail, (c_custkey % 5 IN (2, 3))::INTEGER AS is_wfh, CASE WHEN c_custkey % 5 IN (2, 3) THEN greatest(c_custkey % 6 - 1, 0) ELSE 0 END::DOUBLE AS wfh_days_num
FROM k
""")
def respondent_table(spark, d):
    key = F.col("c_custkey")
    raw = table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        "c_custkey", F.when(key % 3 != 0, "1").otherwise("0").alias("Finished"), (key % 700 + 100).cast("string").alias("Duration (in seconds)"),
        (F.col("c_nationkey") % 5).cast("string").alias("Q2_24"), (key % 6 + 1).cast("string").alias("age_band"), (key % 17 + 1).cast("string").alias("income_band"),
        (key % 4).cast("string").alias("car_access"), (key % 5).cast("string").alias("work_arrangement"), (key % 6).cast("string").alias("wfh_days"), (key % 7).cast("string").alias("household_size"),
    )
    kept, _ = plan.screen_respondents(raw, "Finished", "Duration (in seconds)", "Q2_24")
    people = plan.recode(plan.number_respondents(kept, ["c_custkey"]))
    return people.select("c_custkey", "person_id", "age_num", "car_avail", "is_wfh", "wfh_days_num")


# ------------------------------------------------------------------ design


def profiles(spark, d):
    """Each part as a profile of three attributes with three levels."""
    size = F.col("p_size")
    return table(spark, d, "part", "p_partkey", "p_size").select(
        "p_partkey", (size % 3).alias("vib"), (F.floor(size / 3) % 3).cast("int").alias("plea"), (F.floor(size / 9) % 3).cast("int").alias("walk")
    )


PROFILES = "WITH p AS (SELECT p_partkey, p_size % 3 AS vib, (p_size // 3) % 3 AS plea, (p_size // 9) % 3 AS walk FROM part)"


@query("A35", PROFILES + " SELECT * FROM p WHERE NOT (vib = 2 AND plea = 2) AND NOT (vib = 0 AND plea = 0) AND NOT walk = 1")
def allowed_profiles(spark, d):
    return ds.drop_prohibited(profiles(spark, d), [{"vib": 2, "plea": 2}, {"vib": 0, "plea": 0}, {"walk": 1}])


@query("A36", """
WITH a AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)), b AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS j FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT i::INTEGER AS kind, j::INTEGER AS brand, k::INTEGER AS priority FROM a, b, c
""")
def candidate_profiles(spark, d):
    """Full factorial over as many levels as the tables hold of type, brand and priority."""
    p = table(spark, d, "part", "p_type", "p_brand").agg(F.count_distinct("p_type").alias("kind"), F.count_distinct("p_brand").alias("brand")).first()
    o = table(spark, d, "orders", "o_orderpriority").agg(F.count_distinct("o_orderpriority").alias("priority")).first()
    return ds.factorial(spark, {"kind": p["kind"], "brand": p["brand"], "priority": o["priority"]}).drop("profile")


@query("A33", PROFILES + """,
l AS (SELECT 'vib' AS attribute, vib AS level FROM p UNION ALL SELECT 'plea', plea FROM p UNION ALL SELECT 'walk', walk FROM p)
SELECT attribute, level::INTEGER AS level, count(*) AS n, round((SELECT count(*) FROM p) / 3, 6) AS ideal, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM l GROUP BY 1, 2
""")
def level_frequencies(spark, d):
    out = ds.level_balance(profiles(spark, d).drop("p_partkey"), {"vib": 3, "plea": 3, "walk": 3})
    return out.select("attribute", "level", "n", F.round("ideal", 6).alias("ideal"), F.round("share", 6).alias("share"))


@query("A34", """
SELECT l_suppkey, count(*) FILTER ((l_quantity >= 25 AND l_discount >= 0.05 AND (l_quantity > 25 OR l_discount > 0.05)) OR (l_quantity <= 25 AND l_discount <= 0.05 AND (l_quantity < 25 OR l_discount < 0.05))) AS dominated
FROM lineitem GROUP BY 1
""")
def dominated_pairs(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount")
    hit = ds.dominates([F.col("l_quantity"), F.col("l_discount")], [F.lit(25.0), F.lit(0.05)])
    return li.groupBy("l_suppkey").agg(F.count_if(hit).alias("dominated"))


def assembled(spark, d):
    """Design built from supplier rows: main sets, validity sets and repeats, four blocks."""
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n = F.col("s_suppkey")
    alts = F.explode(F.array(F.lit("Alt1"), F.lit("Alt2")))
    base = s.withColumn("alt", alts).withColumn("vib", F.when(F.col("alt") == "Alt1", F.col("s_nationkey") % 3).otherwise((F.col("s_nationkey") + 1) % 3))
    main = base.filter(n % 4 < 2).select(n.alias("choice_set"), "alt", "vib")
    validity = base.filter(n % 4 == 2).select(n.alias("choice_set"), "alt", "vib")
    repeats = s.filter(n % 4 == 3).select(n.alias("choice_set"), (n - 3).alias("retest_of"))
    blocks = s.select(n.alias("choice_set"), (F.floor(n / 4) % 4 + 1).alias("block"))
    return ds.assemble(main, validity, repeats, blocks, ["vib"])


@query("U9 U1", """
WITH s AS (SELECT *, unnest(['Alt1', 'Alt2', 'Opt_Out']) AS alt FROM supplier),
t AS (SELECT s_suppkey AS choice_set, alt, CASE s_suppkey % 4 WHEN 2 THEN 'Extreme_VC' WHEN 3 THEN 'Test_Retest' ELSE 'Main' END AS set_type, CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - 3 END AS retest_of FROM s)
SELECT (choice_set // 4) % 4 + 1 AS block, set_type, choice_set, retest_of, alt, CASE alt WHEN 'Alt1' THEN n.s_nationkey % 3 WHEN 'Alt2' THEN (n.s_nationkey + 1) % 3 END::INTEGER AS vib
FROM t JOIN supplier n ON n.s_suppkey = coalesce(retest_of, choice_set)
""")
def full_design(spark, d):
    return assembled(spark, d)


@query("A32", """
WITH t AS (SELECT s_suppkey AS c, (s_suppkey // 4) % 4 + 1 AS block, s_suppkey % 4 AS k FROM supplier)
SELECT block, count(*) AS total_sets, coalesce(string_agg(c, ', ' ORDER BY c) FILTER (k < 2), '') AS main_sets, coalesce(string_agg(c, ', ' ORDER BY c) FILTER (k = 2), '') AS validity_sets,
  coalesce(string_agg(c, ', ' ORDER BY c) FILTER (k = 3), '') AS retest_sets, coalesce(string_agg(c - 3, ', ' ORDER BY c) FILTER (k = 3), '') AS retest_of FROM t GROUP BY 1
""")
def block_overview(spark, d):
    return ds.block_summary(assembled(spark, d))

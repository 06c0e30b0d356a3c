"""Correlation, regression, components, scales, agreement and model fits."""

from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.dates import age_days, decay_weight
from tripweave.operators import choice_models as cm
from tripweave.operators import linear, posterior
from tripweave.operators import psychometrics as psy
from tripweave.plans import joint_estimation, sensitivity
from tripweave.queries import surveys
from tripweave.queries.registry import query
from tripweave.session import cut_lineage
from tripweave.tables import table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("M1 U8", """
WITH c AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)
SELECT a, b, round(r, 8) AS r, (SELECT count(*) FROM lineitem) AS n FROM c
""")
def correlation_pairs(spark, d):
    return linear.correlations(table(spark, d, "lineitem", *NUMERIC), NUMERIC).withColumn("r", F.round("r", 8))


@query("U8 M1", """
WITH x AS (SELECT l_quantity AS a, l_quantity + l_linenumber AS b, l_extendedprice AS c, l_extendedprice * (1 - l_discount) AS e FROM lineitem)
SELECT * FROM (SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS r FROM x UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM x UNION ALL SELECT 'a', 'e', round(corr(a, e), 6) FROM x
  UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM x UNION ALL SELECT 'b', 'e', round(corr(b, e), 6) FROM x UNION ALL SELECT 'c', 'e', round(corr(c, e), 6) FROM x) WHERE abs(r) >= 0.7
""")
def strong_correlations(spark, d):
    li = table(spark, d, "lineitem", F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_linenumber")).alias("b"), F.col("l_extendedprice").alias("c"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("e"))
    return linear.strong_pairs(linear.correlations(li, ["a", "b", "c", "e"])).select("a", "b", F.round("r", 6).alias("r"))


@query("M2 W15", """
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part)
SELECT p_brand, round(corr(a, b), 8) AS rho, count(*) AS n FROM r GROUP BY 1
""")
def rank_correlation_by_group(spark, d):
    return linear.spearman(table(spark, d, "part", "p_brand", "p_size", "p_retailprice"), "p_size", "p_retailprice", ["p_brand"]).withColumn("rho", F.round("rho", 8))


@query("M2", """
WITH r AS (SELECT l_quantity, l_discount, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem)
SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 8) AS pearson, round(corr(r.a, r.b), 8) AS spearman, round(abs(corr(l_quantity, l_discount) - corr(r.a, r.b)), 8) AS gap FROM r
""")
def rank_gap(spark, d):
    out = linear.rank_gap(table(spark, d, "lineitem", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return out.select("a", "b", *[F.round(c, 8).alias(c) for c in ("pearson", "spearman", "gap")])


@query("M3 M4", """
WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_linenumber) AS m2, stddev_pop(l_linenumber) AS s2, corr(l_quantity, l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, round(sum(((l_quantity - m1) / s1 + sign(r) * (l_linenumber - m2) / s2) / sqrt(2)), 4) AS pc1 FROM lineitem, s GROUP BY 1
""")
def component_scores(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linenumber")
    pca = linear.PrincipalComponents(li, ["l_quantity", "l_linenumber"], "zscore")
    return pca.scores(li, 1).groupBy("l_orderkey").agg(F.round(F.sum("pc1"), 4).alias("pc1"))


@query("M3 M4 W4", """
WITH s AS (SELECT abs(corr(l_quantity, l_linenumber)) AS r, count(*) AS n FROM lineitem)
SELECT 1::INTEGER AS component, round((1 + r) * n / (n - 1), 8) AS eigenvalue, round((1 + r) / 2, 8) AS ratio, round((1 + r) / 2, 8) AS cumulative FROM s
UNION ALL SELECT 2, round((1 - r) * n / (n - 1), 8), round((1 - r) / 2, 8), 1.0 FROM s
""")
def component_variance(spark, d):
    li = table(spark, d, "lineitem", "l_quantity", "l_linenumber")
    out = linear.PrincipalComponents(li, ["l_quantity", "l_linenumber"], "zscore").variance()
    return out.select("component", *[F.round(c, 8).alias(c) for c in ("eigenvalue", "ratio", "cumulative")])


@query("M3")
def component_loadings(spark, d):
    li = table(spark, d, "lineitem", *NUMERIC)
    return linear.PrincipalComponents(li, NUMERIC, "minmax").loadings().withColumn("loading", F.round("loading", 6))


@query("M5", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 8) AS r FROM lineitem")
def simple_regression(spark, d):
    out = linear.simple_regression(table(spark, d, "lineitem", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 8).alias("r"))


@query("M6 M7", """
WITH x AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS a, l_quantity * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS b FROM lineitem),
s AS (SELECT count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM x),
k AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
v AS (SELECT *, (yy - b1 * ay - b2 * by_) / (n - 3) AS s2 FROM k)
SELECT 'l_quantity' AS parameter, round(b1, 7) AS estimate, round(sqrt(s2 * bb / det), 7) AS se, round(b1 / sqrt(s2 * bb / det), 4) AS t FROM v
UNION ALL SELECT 'l_quantity_x_flag', round(b2, 7), round(sqrt(s2 * aa / det), 7), round(b2 / sqrt(s2 * aa / det), 4) FROM v
""")
def multiple_regression(spark, d):
    li = table(spark, d, "lineitem", (F.col("l_extendedprice") / 1000).alias("y"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    li = li.withColumns(linear.interactions(["l_quantity"], "flag"))
    coefficients, _ = linear.ols(li, "y", ["l_quantity", "l_quantity_x_flag"])
    return coefficients.filter("parameter <> 'const'").select("parameter", F.round("estimate", 7).alias("estimate"), F.round("se", 7).alias("se"), F.round("t", 4).alias("t"))


@query("M8", """
WITH s AS (SELECT sum(l_quantity * l_extendedprice) AS xy, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem)
SELECT 'l_quantity' AS variable, round(1 / (1 - xy * xy / xx / yy), 6) AS vif FROM s UNION ALL SELECT 'l_extendedprice', round(1 / (1 - xy * xy / xx / yy), 6) FROM s
""")
def variance_inflation(spark, d):
    out = linear.vif(table(spark, d, "lineitem", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return out.select("variable", F.round("vif", 6).alias("vif"))


@query("M9", """
WITH m AS (SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a, (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()) AS b FROM lineitem),
s AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM m)
SELECT round(sqrt(((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + c * c)) / ((va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + c * c))), 6) AS condition FROM s
""")
def condition_numbers(spark, d):
    li = table(spark, d, "lineitem", "l_quantity", "l_tax")
    value = linear.condition_number(li, ["l_quantity", "l_tax"])
    return spark.createDataFrame([(round(value, 6),)], "condition double")


# ------------------------------------------------------------------ scales and agreement

ITEMS = ["i1", "i2", "i3"]
ITEM_SQL = """
WITH i AS (SELECT l_quantity AS i1, l_quantity + 20 * l_linenumber AS i2, l_quantity - 100 * l_discount + 30 * l_linenumber AS i3, l_extendedprice / 1000 AS j1, l_extendedprice / 1000 + l_tax * 300 AS j2 FROM lineitem)
"""


def items(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select(
        q.alias("i1"), (q + 20 * F.col("l_linenumber")).alias("i2"), (q - 100 * F.col("l_discount") + 30 * F.col("l_linenumber")).alias("i3"),
        p.alias("j1"), (p + F.col("l_tax") * 300).alias("j2"),
    )


@query("M10", ITEM_SQL + """
SELECT 'i1' AS item, round(corr(i1, i2 + i3), 8) AS r, corr(i1, i2 + i3) < 0.2 AS low FROM i UNION ALL SELECT 'i2', round(corr(i2, i1 + i3), 8), corr(i2, i1 + i3) < 0.2 FROM i
UNION ALL SELECT 'i3', round(corr(i3, i1 + i2), 8), corr(i3, i1 + i2) < 0.2 FROM i
""")
def item_total_correlations(spark, d):
    return psy.item_total(items(spark, d), ITEMS).withColumn("r", F.round("r", 8))


@query("M11", ITEM_SQL + """,
r AS (SELECT count(*) AS n, corr(i1, i2) AS a, corr(i1, i3) AS b, corr(i2, i3) AS c FROM i),
p AS (SELECT *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS pb, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS pc FROM r)
SELECT round((a * a + b * b + c * c) / (a * a + b * b + c * c + pa * pa + pb * pb + pc * pc), 8) AS kmo, round(-(n - 1 - 11 / 6) * ln(1 + 2 * a * b * c - a * a - b * b - c * c), 3) AS chi2, 3.0::DOUBLE AS dof FROM p
""")
def sampling_adequacy(spark, d):
    overall = psy.kmo_bartlett(items(spark, d), ITEMS)[1]
    return overall.select(F.round("kmo", 8).alias("kmo"), F.round("chi2", 3).alias("chi2"), "dof")


@query("M12", ITEM_SQL + """
SELECT 'I' AS scale, 3::INTEGER AS n_items, count(*) AS n, round(1.5 * (1 - (var_samp(i1) + var_samp(i2) + var_samp(i3)) / var_samp(i1 + i2 + i3)), 8) AS alpha FROM i
UNION ALL SELECT 'J', 2, count(*), round(2 * (1 - (var_samp(j1) + var_samp(j2)) / var_samp(j1 + j2)), 8) FROM i
""")
def scale_reliability(spark, d):
    out = psy.cronbach_alpha(items(spark, d), {"I": ITEMS, "J": ["j1", "j2"]})
    return out.select("scale", "n_items", "n", F.round("alpha", 8).alias("alpha"))


def loadings(spark, d):
    return table(spark, d, "part", F.col("p_brand").alias("lv"), F.col("p_partkey").alias("item"), (F.col("p_size") / 60 - 0.1).alias("loading"))


@query("M13", """
WITH l AS (SELECT p_brand AS lv, p_size / 60 - 0.1 AS x FROM part)
SELECT lv, round(avg(x * x), 8) AS ave, round(pow(sum(abs(x)), 2) / (pow(sum(abs(x)), 2) + sum(1 - x * x)), 8) AS cr, round(pow(sum(x), 2) / (pow(sum(x), 2) + sum(1 - x * x)), 8) AS omega, avg(x * x) >= 0.5 AS ave_ok FROM l GROUP BY 1
""")
def loading_validity(spark, d):
    out = psy.loading_summary(loadings(spark, d))
    return out.select("lv", *[F.round(c, 8).alias(c) for c in ("ave", "cr", "omega")], "ave_ok")


@query("M14", """
SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(l_quantity, l_tax), 6) AS r FROM lineitem UNION ALL SELECT 'l_tax', 'l_quantity', round(corr(l_quantity, l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_quantity', round(sqrt(avg(pow(l_quantity / 60, 2))), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', round(sqrt(avg(pow(l_tax * 10, 2))), 6) FROM lineitem
""")
def discriminant_validity(spark, d):
    li = table(spark, d, "lineitem", "l_quantity", "l_tax")
    loads = li.select(F.inline(F.array(
        F.struct(F.lit("l_quantity").alias("lv"), (F.col("l_quantity") / 60).alias("loading")), F.struct(F.lit("l_tax").alias("lv"), (F.col("l_tax") * 10).alias("loading"))
    )))
    out = psy.discriminant_matrix(linear.correlations(li, ["l_quantity", "l_tax"]), psy.loading_summary(loads))
    return out.withColumn("r", F.round("r", 6))


@query("M15", ITEM_SQL + """
SELECT 'I' AS lv1, 'J' AS lv2, round((abs(corr(i1, j1)) + abs(corr(i1, j2)) + abs(corr(i2, j1)) + abs(corr(i2, j2)) + abs(corr(i3, j1)) + abs(corr(i3, j2))) / 6, 8) AS htmt, TRUE AS pass_085, TRUE AS pass_090 FROM i
""")
def cross_construct_ratio(spark, d):
    return psy.cross_construct(items(spark, d), {"I": ITEMS, "J": ["j1", "j2"]}).withColumn("htmt", F.round("htmt", 8))


def rated(spark, d):
    return surveys.ratings(spark, d).withColumn("rating", F.col("rating") + F.when(F.col("image") > 6, 1.0).otherwise(0.0))


RATED = surveys.RATED.replace("WITH r AS", "WITH r0 AS") + ", r AS (SELECT person_id, image, rating + CASE WHEN image > 6 THEN 1 ELSE 0 END AS rating FROM r0)"


@query("M16", RATED + """,
f AS (SELECT person_id FROM r WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) = 12), x AS (SELECT r.* FROM r JOIN f USING (person_id)),
g AS (SELECT avg(rating) AS g, var_pop(rating) * count(*) AS sst FROM x), k AS (SELECT count(*) AS k FROM f),
t AS (SELECT sum(pow(m - g, 2)) AS a FROM (SELECT avg(rating) AS m FROM x GROUP BY image), g), u AS (SELECT sum(pow(m - g, 2)) AS b FROM (SELECT avg(rating) AS m FROM x GROUP BY person_id), g),
s AS (SELECT k, a * k / 11 AS msr, b * 12 / (k - 1) AS msc, (sst - a * k - b * 12) / (11 * (k - 1)) AS mse FROM g, k, t, u)
SELECT 12::BIGINT AS n_targets, k AS n_raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / 12), 8) AS icc FROM s
""")
def rater_agreement(spark, d):
    return psy.icc_two_way(rated(spark, d), "image", "person_id", "rating").withColumn("icc", F.round("icc", 8))


@query("M17", RATED + """,
u AS (SELECT image, rating::INTEGER AS c, count(*)::DOUBLE AS n FROM r WHERE rating IS NOT NULL GROUP BY 1, 2), m AS (SELECT image, sum(n) AS m FROM u GROUP BY 1),
o AS (SELECT a.c AS c, b.c AS k, sum(a.n * (b.n - CASE WHEN a.c = b.c THEN 1 ELSE 0 END) / (m - 1)) AS o FROM u a JOIN u b USING (image) JOIN m USING (image) GROUP BY 1, 2),
n AS (SELECT c, sum(o) AS n FROM o GROUP BY 1), tot AS (SELECT sum(n) AS t FROM n),
e AS (SELECT x.c AS c, y.c AS k, x.n * y.n AS e, pow((SELECT sum(z.n) FROM n z WHERE z.c BETWEEN least(x.c, y.c) AND greatest(x.c, y.c)) - (x.n + y.n) / 2, 2) AS d FROM n x, n y WHERE x.c <> y.c)
SELECT round(any_value(t), 4) AS n_pairable, round(1 - (any_value(t) - 1) * sum(o * d) / sum(e * d), 8) AS alpha FROM e LEFT JOIN o ON o.c = e.c AND o.k = e.k, tot
""")
def ordinal_agreement(spark, d):
    out = psy.krippendorff_ordinal(rated(spark, d), "image", "rating", [1, 2, 3, 4])
    return out.select(F.round("n_pairable", 4).alias("n_pairable"), F.round("alpha", 8).alias("alpha"))


@query("A29", RATED + "SELECT CASE WHEN image > 6 THEN 'late' ELSE 'early' END AS dim, round(avg(rating), 8) AS mean, round(stddev_pop(rating), 8) AS sd, count(rating) AS n FROM r GROUP BY 1")
def rating_moments(spark, d):
    r = rated(spark, d).withColumn("dim", F.when(F.col("image") > 6, "late").otherwise("early"))
    return psy.describe_ratings(r, "dim", "rating").select("dim", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "n")


# ------------------------------------------------------------------ fits

TERMS = {"ASC_A": (None, [0]), "ASC_B": (None, [1]), "beta_gtc": ("gtc", [0, 1]), "beta_med": ("D_med", [0, 1]), "beta_lrg": ("D_lrg", [0, 1])}
COUNT_FEATURES = ["beta_med", "beta_lrg", "late", "urgent"]


def standard_tasks(spark, d, names):
    long = surveys.choices(spark, d).filter("task_type = 'Standard'").withColumn("gtc", F.col("gtc") / 100)
    return cm.choice_arrays(long, "obs_id", "alt_num", [0, 1, 2], {n: TERMS[n] for n in names})


def count_table(spark, d):
    """Orders per customer with an offset and four features."""
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus").groupBy(F.col("o_custkey").alias("poi_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"),
        F.avg((F.col("o_orderstatus") == "P").cast("int")).alias("late"),
    )
    key = F.col("poi_id")
    return o.withColumns({
        "base": 5.0 + F.pmod(key, F.lit(7)), "beta_med": (F.pmod(key, F.lit(3)) == 1).cast("double"), "beta_lrg": (F.pmod(key, F.lit(3)) == 2).cast("double"),
    })


PRIORS = {**K.SIZE_PRIORS, "late": (0.0, 1.0), "urgent": (0.0, 1.0)}


@query("M18 U6")
def choice_model(spark, d):
    names = list(TERMS)
    fit = cm.fit_logit(standard_tasks(spark, d, names), names, 3)
    return fit.table(spark).select("parameter", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "t", "p")], "sig")


@query("M18 M19")
def choice_model_comparison(spark, d):
    every = list(TERMS)
    data = cut_lineage(standard_tasks(spark, d, every))
    fits = {}
    for label, names in (("cost only", every[:3]), ("cost and size", every)):
        x = F.array(*[F.col("x")[a * len(every) + every.index(n)] for a in range(3) for n in names])
        fits[label] = cm.fit_logit(data.select(x.alias("x"), "pos"), names, 3)
    test = cm.lr_test(spark, fits["cost only"], fits["cost and size"], "size added").select(F.lit("LR test").alias("model"), F.col("df").cast("double").alias("n_params"), F.col("lr").alias("ll"))
    table_ = cm.compare_fits(spark, fits).unionByName(test, allowMissingColumns=True)
    return table_.select("model", "n_params", *[F.round(c, 6).alias(c) for c in ("ll", "ll_null", "rho2", "aic", "bic")])


@query("M20 M22")
def count_model(spark, d):
    rows = cm.count_rows(count_table(spark, d), "n", "base", COUNT_FEATURES)
    fit = cm.fit_counts(rows, COUNT_FEATURES, PRIORS)
    return cm.prior_table(spark, fit, "counts").select("parameter", F.round("prior_mu", 5).alias("prior_mu"), F.round("prior_sigma", 5).alias("prior_sigma"), "source")


@query("M21 M22")
def joint_model(spark, d):
    names = list(TERMS)
    fit = cm.fit_joint(standard_tasks(spark, d, names), names, 3, cm.count_rows(count_table(spark, d), "n", "base", COUNT_FEATURES), COUNT_FEATURES, PRIORS)
    return fit.table(spark).select("parameter", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


@query("M18 M20 M21 M22")
def survey_to_joint(spark, d):
    """The plan from survey choices over counts to the final table."""
    names = list(TERMS)
    rows = cm.count_rows(count_table(spark, d), "n", "base", COUNT_FEATURES)
    out = joint_estimation.run(standard_tasks(spark, d, names), names, 3, rows, COUNT_FEATURES, {"late": (0.0, 1.0), "urgent": (0.0, 1.0)})
    return out["final"].select("parameter", "layer", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "low", "high", "p_positive")], "converged")


@query("M24", """
WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(corr(y, p), 8) AS r, round(var_pop(p) / (var_pop(p) + var_pop(y - p)), 8) AS r2 FROM x
""")
def prediction_metrics(spark, d):
    li = table(spark, d, "lineitem", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    out = cm.fit_metrics(li, "l_extendedprice", "p")
    return out.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r", 8).alias("r"), F.round("r2", 8).alias("r2"))


@query("M23 F39", """
WITH v AS (SELECT l_returnflag || l_linestatus AS param, (l_extendedprice - 20000 - l_quantity * 1000) / 1000 AS value FROM lineitem)
SELECT param, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg((value > 0)::INTEGER), 6) AS p_positive, round(quantile_cont(value, 0.03), 4) AS hdi_3, round(quantile_cont(value, 0.97), 4) AS hdi_97,
  CASE WHEN avg((value > 0)::INTEGER) > 0.9 THEN 'positive' WHEN avg((value > 0)::INTEGER) < 0.1 THEN 'negative' ELSE 'uncertain' END AS verdict, quantile_cont(value, 0.03) > 0 OR quantile_cont(value, 0.97) < 0 AS significant
FROM v GROUP BY 1
""")
def draws_table(spark, d):
    value = (F.col("l_extendedprice") - 20000 - F.col("l_quantity") * 1000) / 1000
    draws = table(spark, d, "lineitem", F.concat("l_returnflag", "l_linestatus").alias("param"), value.alias("value"))
    out = posterior.draws_summary(draws)
    return out.select("param", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p_positive")], F.round("hdi_3", 4).alias("hdi_3"), F.round("hdi_97", 4).alias("hdi_97"), "verdict", "significant")


@query("M25", """
WITH s AS (SELECT l_suppkey, 1 + stddev_samp(l_tax) AS r_hat, sum(l_quantity) / 30 AS ess_bulk FROM lineitem GROUP BY 1)
SELECT 'rhat over 1.05' AS "check", count(*) FILTER (r_hat > 1.05) AS count FROM s UNION ALL SELECT 'rhat over 1.01', count(*) FILTER (r_hat > 1.01) FROM s UNION ALL SELECT 'ess below 400', count(*) FILTER (ess_bulk < 400) FROM s
""")
def convergence_checks(spark, d):
    per = table(spark, d, "lineitem", "l_suppkey", "l_tax", "l_quantity").groupBy("l_suppkey").agg((1 + F.stddev("l_tax")).alias("r_hat"), (F.sum("l_quantity") / 30).alias("ess_bulk"))
    return posterior.convergence_counts(per)


@query("O13 O14", """
WITH g AS (SELECT * FROM (VALUES (365.0, 4.0, 0.6, TRUE), (270.0, 4.0, 0.6, FALSE), (730.0, 4.0, 0.6, FALSE), (365.0, 2.0, 0.6, FALSE), (365.0, 15.0, 0.6, FALSE), (365.0, 4.0, 0.0, FALSE), (365.0, 4.0, 1.0, FALSE)) v(hl, kappa, alpha, base)),
w AS (SELECT event_type AS parameter, value, hl, kappa, alpha, base, exp(-ln(2) / hl::DOUBLE * date_diff('day', ts::DATE, DATE '2024-03-01')) AS w FROM events, g),
m AS (SELECT parameter, hl, kappa, alpha, base, (sum(w * value) / sum(w) * 5 + kappa * alpha * 50) / (5 + kappa) AS mean, stddev_pop(value) / 4 AS sd FROM w GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT parameter, mean AS b, sd FROM m WHERE base)
SELECT parameter, round(any_value(b), 6) AS base_mean, round(max(abs(mean - b)), 6) AS max_shift, bool_and((mean > 40) = (b > 40)) AS verdict_stable, bool_and((mean > 40) = (b > 40)) AND max(abs(mean - b)) < any_value(b.sd) AS robust
FROM m JOIN b USING (parameter) GROUP BY 1
""")
def parameter_robustness(spark, d):
    ev = cut_lineage(table(spark, d, "events", F.col("event_type").alias("parameter"), "value", age_days(F.to_date("ts"), "2024-03-01").alias("age")))

    def score(half_life, kappa, alpha):
        w = decay_weight(F.col("age"), half_life)
        mean = (F.sum(w * F.col("value")) / F.sum(w) * 5 + kappa * alpha * 50) / (5 + kappa)
        return ev.groupBy("parameter").agg(mean.alias("mean"), (F.stddev_pop("value") / 4).alias("sd"), (mean > 40).alias("significant"))

    out = sensitivity.judge(sensitivity.run_grid(spark, score))
    return out.select("parameter", F.round("base_mean", 6).alias("base_mean"), F.round("max_shift", 6).alias("max_shift"), "verdict_stable", "robust")

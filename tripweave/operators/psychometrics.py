"""Reliability, validity and agreement of rating scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.numeric import row_mean
from tripweave.operators.linear import correlations, moments
from tripweave.operators.tails import chi2_upper, f_quantile


def subscale_means(df: DataFrame, scales: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one mean column per subscale; unanswered items are skipped."""
    return df.withColumns({name: row_mean(*[F.col(i) for i in items]) for name, items in scales.items()})


def item_total(df: DataFrame, items: Sequence[str], low: float = 0.20) -> DataFrame:
    """Correlation of each item with the sum of the others, and a low flag."""
    df = df.dropna(subset=list(items))
    total = sum((F.col(i) for i in items[1:]), F.col(items[0]))
    one = df.agg(*[F.corr(F.col(i).cast("double"), (total - F.col(i)).cast("double")).alias(i) for i in items])
    rows = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).alias("r")) for i in items])
    return one.select(F.inline(rows)).withColumn("low", F.col("r") < low)


def kmo_bartlett(df: DataFrame, items: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sampling adequacy per item, and the overall figure with the sphericity test."""
    n, _, cov = moments(df, items)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    inverse = np.linalg.inv(r)
    scale = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(scale, scale)
    off = ~np.eye(len(items), dtype=bool)
    r2, p2 = np.where(off, r**2, 0), np.where(off, partial**2, 0)
    spark = df.sparkSession
    per_item = [(i, float(a / (a + b))) for i, a, b in zip(items, r2.sum(axis=0), p2.sum(axis=0))]
    k = len(items)
    chi2 = -(n - 1 - (2 * k + 5) / 6) * float(np.linalg.slogdet(r)[1])
    dof = k * (k - 1) / 2
    item_table = spark.createDataFrame(per_item, "item string, msa double").withColumn("drop", F.col("msa") < 0.50)
    overall = spark.createDataFrame(
        [(float(r2.sum() / (r2.sum() + p2.sum())), chi2, dof, chi2_upper(chi2, dof))],
        "kmo double, chi2 double, dof double, p double",
    )
    return item_table, overall


def cronbach_alpha(df: DataFrame, scales: Mapping[str, Sequence[str]], level: float = 0.95) -> DataFrame:
    """Alpha with its F-based interval and a verdict per subscale. A scale with fewer than 10
    complete rows, or fewer than two items, keeps its row and count; its figures are NULL."""
    rows = []
    for name, items in scales.items():
        k = len(items)
        n = df.dropna(subset=list(items)).count()
        if n < 10 or k < 2:
            rows.append((name, k, n, None, None, None, None))
            continue
        n, _, cov = moments(df, items)
        alpha = k / (k - 1) * (1 - float(np.trace(cov) / cov.sum()))
        d1, d2 = n - 1, (n - 1) * (k - 1)
        tail = (1 - level) / 2
        low = 1 - (1 - alpha) * f_quantile(1 - tail, d1, d2)
        high = 1 - (1 - alpha) * f_quantile(tail, d1, d2)
        rows.append((name, k, n, alpha, low, high, alpha >= 0.70))
    return df.sparkSession.createDataFrame(
        rows, "scale string, n_items int, n bigint, alpha double, low double, high double, acceptable boolean"
    )


def loading_summary(loadings: DataFrame) -> DataFrame:
    """AVE, composite reliability and omega per latent variable from (lv, item, loading)."""
    x = F.col("loading")
    error = F.sum(1 - x * x)
    strength = F.pow(F.sum(F.abs(x)), 2)
    signed = F.pow(F.sum(x), 2)
    return loadings.groupBy("lv").agg(
        F.avg(F.abs(x)).alias("mean_abs"), F.min(F.abs(x)).alias("min_abs"), F.avg(x * x).alias("ave"),
        (strength / (strength + error)).alias("cr"), (signed / (signed + error)).alias("omega"),
    ).withColumns({"ave_ok": F.col("ave") >= 0.50, "cr_ok": F.col("cr") >= 0.70, "omega_ok": F.col("omega") >= 0.70})


def discriminant_matrix(lv_correlations: DataFrame, summary: DataFrame) -> DataFrame:
    """Long correlation matrix of latent variables with sqrt(AVE) on the diagonal."""
    diagonal = summary.select(F.col("lv").alias("a"), F.col("lv").alias("b"), F.sqrt("ave").alias("r"))
    off = lv_correlations.select("a", "b", "r")
    return off.unionByName(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diagonal)


def cross_construct(df: DataFrame, scales: Mapping[str, Sequence[str]], min_pairs: int = 6) -> DataFrame:
    """Mean absolute correlation between the items of two subscales, with the pass marks."""
    owner = {i: s for s, items in scales.items() for i in items}
    long = correlations(df, list(owner)).filter(F.col("n") >= min_pairs)

    def scale_of(c: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for pair in owner.items() for v in pair]), F.col(c))

    between = long.withColumn("lv1", scale_of("a")).withColumn("lv2", scale_of("b")).filter("lv1 <> lv2")
    value = F.avg(F.abs("r"))
    return between.groupBy("lv1", "lv2").agg(
        value.alias("htmt"), (value < 0.85).alias("pass_085"), (value < 0.90).alias("pass_090")
    )


def icc_two_way(df: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) from two-way mean squares over raters who rated every target."""
    rated = df.dropna(subset=[value])
    targets = rated.agg(F.count_distinct(target).alias("_all"))
    full = rated.groupBy(rater).agg(F.count_distinct(target).alias("_n")).crossJoin(F.broadcast(targets))
    rated = rated.join(full.filter("_n = _all").select(rater), rater, "left_semi")
    mean = F.avg(value)
    by_target = rated.groupBy(target).agg(mean.alias("_m"), F.count(value).alias("_k"))
    by_rater = rated.groupBy(rater).agg(mean.alias("_m"), F.count(value).alias("_k"))
    overall = rated.agg(F.var_pop(value).alias("_v"), F.count(value).alias("_rows"))
    t = by_target.agg((F.var_pop("_m") * F.count("_m")).alias("_sst"), F.count("_m").alias("_n"))
    r = by_rater.agg((F.var_pop("_m") * F.count("_m")).alias("_ssr"), F.count("_m").alias("_r"))
    one = overall.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(r))
    n, k = F.col("_n"), F.col("_r")
    msr = F.col("_sst") * k / (n - 1)
    msc = F.col("_ssr") * n / (k - 1)
    sse = F.col("_v") * F.col("_rows") - F.col("_sst") * k - F.col("_ssr") * n
    mse = sse / ((n - 1) * (k - 1))
    icc = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
    return one.select(n.alias("n_targets"), k.alias("n_raters"), icc.alias("icc"))


def krippendorff_ordinal(df: DataFrame, unit: str, value: str, scale: Sequence[int]) -> DataFrame:
    """Ordinal alpha. One row per unit of value counts; no pair of ratings is ever formed.

    Values outside ``scale`` take no part; ``n_outside`` counts them. Without a unit of two ratings alpha is NULL.
    """
    counts = df.dropna(subset=[value]).groupBy(unit).agg(
        *[F.count_if(F.col(value) == c).cast("double").alias(f"c{i}") for i, c in enumerate(scale)],
        F.count_if(~F.col(value).isin(list(scale))).alias("outside"),
    )
    k = range(len(scale))
    m = sum((F.col(f"c{i}") for i in k), F.lit(0.0))
    counts = counts.withColumn("m", m)
    others = F.when(F.col("m") >= 2, F.col("m") - 1)
    row = counts.agg(
        F.sum("outside").alias("outside"),
        *[
            F.sum(F.col(f"c{i}") * (F.col(f"c{j}") - (1 if i == j else 0)) / others).alias(f"o{i}_{j}")
            for i in k for j in k
        ],
    ).first()
    schema = "n_pairable double, n_outside bigint, alpha double"
    if row["o0_0"] is None:
        return df.sparkSession.createDataFrame([(0.0, row["outside"] or 0, None)], schema)
    o = np.array([[row[f"o{i}_{j}"] for j in k] for i in k], dtype=float)
    marginal = o.sum(axis=1)
    total = marginal.sum()
    gap = np.zeros_like(o)
    for i in k:
        for j in range(i + 1, len(scale)):
            gap[i, j] = gap[j, i] = (marginal[i : j + 1].sum() - (marginal[i] + marginal[j]) / 2) ** 2
    expected = float((np.outer(marginal, marginal) * gap).sum())
    alpha = 1.0 if expected == 0 else 1 - (total - 1) * float((o * gap).sum()) / expected
    return df.sparkSession.createDataFrame([(float(total), row["outside"], float(alpha))], schema)


def describe_ratings(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Mean and population sd per dimension."""
    return df.groupBy(dim).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))



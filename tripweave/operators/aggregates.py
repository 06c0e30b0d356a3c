"""Grouped summaries: counts, weighted moments, quality metrics, invariants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.quantiles import exact_quantiles


def counts_by(df: DataFrame, keys: Sequence[str], drop_nulls: bool = True) -> DataFrame:
    """Rows per key combination, largest first. NULL keys are dropped unless asked for."""
    if drop_nulls:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *keys)


def metric_rows(df: DataFrame, metrics: Mapping[str, Column], label: str = "category",
                value: str = "count") -> DataFrame:
    """One aggregate pass turned into (label, value) rows, in the given order."""
    one = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(metrics.values())])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias(label), F.col(f"_{i}").cast("double" if value != "count" else "bigint").alias(value))
            for i, name in enumerate(metrics)
        ]
    )
    return one.select(F.inline(rows))


def status_report(df: DataFrame, status: str, known: Mapping[str, str], patterns: Mapping[str, str],
                  other_prefix: str, missing: str = "(none)") -> DataFrame:
    """Counts of known statuses, of status patterns, and one row per remaining status, a NULL
    one included (shown as ``missing``)."""
    metrics = {"Total Records": F.count(F.lit(1))}
    metrics |= {label: F.count_if(F.col(status) == s) for label, s in known.items()}
    metrics |= {label: F.count_if(F.col(status).contains(p)) for label, p in patterns.items()}
    shown = F.coalesce(F.col(status), F.lit(missing))
    rest = df.filter(~shown.isin(list(known.values())))
    for p in patterns.values():
        rest = rest.filter(~shown.contains(p))
    others = rest.groupBy(shown.alias("_shown")).agg(F.count(F.lit(1)).alias("count"))
    others = others.select(F.concat(F.lit(other_prefix), F.col("_shown")).alias("category"), "count")
    return metric_rows(df, metrics).unionByName(others)


def group_summary(df: DataFrame, key: str, value: str, condition: Column) -> DataFrame:
    """Mean, exact median, conditional count and count per group."""
    base = df.groupBy(key).agg(
        F.avg(value).alias("mean"),
        F.count_if(condition).alias("n_condition"),
        F.count(value).alias("n_total"),
    )
    return base.join(exact_quantiles(df, [key], value, {"median": 0.5}), key, "left")


def weighted_moments(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Weight sum, effective sample size, and weighted mean and variance per value.

    A NULL value drops its weight for that column only. The variance is taken about the
    group mean in a second pass, which keeps digits the one-pass form loses.
    """
    keys = list(keys)
    w = F.col(weight)

    def used(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), w)

    first = df.groupBy(*keys).agg(
        F.sum(w).alias("weight_sum"),
        (F.sum(w) * F.sum(w) / F.nullif(F.sum(w * w), F.lit(0.0))).alias("n_eff"),
        *[F.try_divide(F.sum(w * F.col(v)), F.sum(used(v))).alias(f"{v}_mean") for v in values],
    )
    centred = df.join(first.select(*keys, *[f"{v}_mean" for v in values]), keys)
    second = centred.groupBy(*keys).agg(
        *[
            F.try_divide(F.sum(w * F.pow(F.col(v) - F.col(f"{v}_mean"), 2)), F.sum(used(v))).alias(f"{v}_var")
            for v in values
        ]
    )
    return first.join(second, keys)


def floored_average(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str,
                    floor: float = 1e-9) -> DataFrame:
    """Weighted mean whose weights never fall below ``floor``."""
    w = F.greatest(F.col(weight), F.lit(floor))
    return df.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(out))


def mean_of_means(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, out: str) -> DataFrame:
    """Unweighted mean over inner-group means."""
    means = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_mean"))
    return means.groupBy(*outer).agg(F.avg("_mean").alias(out))


def category_entropy(df: DataFrame, key: str, category: str, kinds: int, out: str, weight: str | None = None) -> DataFrame:
    """Shannon entropy of a category mix per key, divided by ``ln kinds`` and held in [0, 1]."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(key, category).agg(n.cast("double").alias("_n")).filter(F.col("_n") > 0)
    # -sum p ln p == ln N - sum(n ln n) / N
    total = F.sum("_n")
    entropy = F.ln(total) - F.sum(F.col("_n") * F.ln("_n")) / total
    return counts.groupBy(key).agg(
        F.greatest(F.least(entropy / F.ln(F.lit(float(kinds))), F.lit(1.0)), F.lit(0.0)).alias(out)
    )


def between_share(df: DataFrame, category: str, *values: str) -> DataFrame:
    """R-squared of each numeric on a category: 1 - within / total sum of squares."""
    stacked = df.dropna(subset=[category]).unpivot(
        [category], [*values], "variable", "value"
    ).dropna(subset=["value"])
    moments = stacked.groupBy("variable", category).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    total = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m")))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    within = F.sum(F.col("n") * F.col("v"))
    return moments.groupBy("variable").agg(
        (1 - within / F.nullif(total - F.sum("n") * grand * grand, F.lit(0.0))).alias("r2"),
        F.sum("n").alias("n"),
    )


def quality_row(df: DataFrame, check: str, value: Column, pct: Column | None, flag: Column, note: str) -> DataFrame:
    """One line of a quality log from one-row aggregates of ``df``."""
    return df.agg(
        F.lit(check).alias("check"),
        value.cast("double").alias("value"),
        (pct if pct is not None else F.lit(None)).cast("double").alias("pct"),
        flag.alias("flag"),
        F.lit(note).alias("note"),
    )


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rule name and number of violating rows; all zero means every invariant holds."""
    return metric_rows(df, {n: F.count_if(F.coalesce(bad, F.lit(False))) for n, bad in rules.items()}, "rule")


def compare_columns(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]], tolerance: float = 1e-6) -> DataFrame:
    """Largest absolute difference of recomputed and stored columns, and whether they agree."""
    stats = metric_rows(df, {n: F.max(F.abs(a - b)) for n, (a, b) in pairs.items()}, "column", "max_abs_diff")
    return stats.withColumn("agrees", F.col("max_abs_diff") < tolerance)

"""Column profiles and data-quality reports. Each is one pass over unpivoted columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.aggregates import metric_rows
from tripweave.operators.quantiles import exact_quantiles


def long_form(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value) rows with every value as double."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(list(keys), list(cols), "column", "value")


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def describe(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Count, moments, shape, missing share and exact quantiles per column."""
    rows = long_form(df, cols)
    base = rows.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        sample_skewness("value").alias("skewness"), sample_kurtosis("value").alias("kurtosis"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.bround(F.avg(F.col("value").isNull().cast("double")) * 100, 2).alias("null_pct"),
    )
    return base.join(exact_quantiles(rows, ["column"], "value", probs), "column", "left")


def missing_report(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Missing count and share per column, with its column group when given."""
    group_of = {c: g for g, cs in (groups or {}).items() for c in cs}
    cols = [c for c in df.columns if not groups or c in group_of]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(
        *[
            F.struct(
                F.lit(group_of.get(c, "all")).alias("column_group"), F.lit(c).alias("column"),
                F.col(c).alias("missing_count"),
                F.bround(F.try_divide(F.col(c) * 100.0, F.col("_n")), 2).alias("missing_pct"),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            )
            for c in cols
        ]
    )
    return one.select(F.inline(rows))


def missing_bands(report: DataFrame) -> DataFrame:
    """Columns complete, below 10 %, and above, from a missing report."""
    pct = F.col("missing_pct")
    return metric_rows(
        report,
        {"complete": F.count_if(pct == 0), "up to 10 %": F.count_if((pct > 0) & (pct <= 10)),
         "over 10 %": F.count_if(pct > 10)},
        "band",
    )


def information_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero share, share of the commonest value, sd, distinct count, and the flags they raise."""
    rows = long_form(df, cols).dropna(subset=["value"])
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n"), F.sum("n")
    base = counts.groupBy("column").agg(
        (F.sum(F.when(F.col("value") == 0, n).otherwise(0)) / total).alias("zero_share"),
        (F.max("n") / total).alias("top_share"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    spread = rows.groupBy("column").agg(F.stddev("value").alias("std"))
    flags = F.concat_ws(
        " | ",
        F.when(F.col("zero_share") > 0.80, "HIGH-ZERO"),
        F.when(F.col("top_share") > 0.95, "NEAR-CONST"),
        F.when(F.col("std") < 0.01, "LOW-STD"),
        F.when(F.col("n_unique") <= 2, "BINARY"),
    )
    return base.join(spread, "column").select("column", "zero_share", "top_share", "std", "n_unique", flags.alias("flags"))


def range_check(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Minimum, maximum and share of values outside a closed range, per column."""
    value = F.col("value")
    return (
        long_form(df, cols).groupBy("column").agg(
            F.min(value).alias("min"), F.max(value).alias("max"),
            F.avg((value > high).cast("double")).alias("share_above"),
            F.avg((value < low).cast("double")).alias("share_below"),
        )
        .withColumn("in_range", (F.col("share_above") == 0) & (F.col("share_below") == 0))
    )


def group_distribution(df: DataFrame, key: str, value: str, limits: Sequence[Column]) -> DataFrame:
    """Location, spread, 3 x IQR fences (low fence at least 0) and counts outside per group.

    ``limits`` are four columns of ``df`` (min, typical min, typical max, max).
    """
    df = df.filter(F.col(value).isNotNull())
    q = exact_quantiles(df, [key], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    q = q.withColumn("iqr_lower", F.greatest(F.col("q25") - 3 * iqr, F.lit(0.0))).withColumn(
        "iqr_upper", F.col("q75") + 3 * iqr
    )
    x = F.col(value)
    stats = df.join(q, key).groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.count_if(x < limits[0]).alias("below_min"), F.count_if(x < limits[1]).alias("below_typical"),
        F.count_if(x > limits[2]).alias("above_typical"), F.count_if(x > limits[3]).alias("above_max"),
        F.count_if(x < F.col("iqr_lower")).alias("low_outliers"),
        F.count_if(x > F.col("iqr_upper")).alias("high_outliers"),
    )
    return stats.join(q, key)


def match_rates(df: DataFrame, key: str, matched: Column) -> DataFrame:
    """Total, matched, unmatched and match rate per group."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"),
        F.count_if(~matched).alias("no_match"), F.avg(matched.cast("double")).alias("match_rate"),
    )


def low_rate_advice(rates: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """Groups whose match rate is below the threshold, with the action to take."""
    return rates.filter(F.col("match_rate") < threshold).select(
        key, "match_rate", "no_match",
        F.when(F.col("match_rate") < threshold / 2, "find another source").otherwise("review by hand").alias("advice"),
    )


def sanity_rules(df: DataFrame, area: str, method: Column, core: Column, group: Column) -> DataFrame:
    """Counts behind three area rules: unit slips, buffered points, and core-vs-all medians.

    ``core_smaller`` compares the exact median over ``group & core`` with that over
    ``group``: true below half.
    """
    unit = (F.col(area) > 0) & (F.col(area) < 20)
    buffered = F.lower(method).contains("buffer") & (F.col(area) > 20000)
    counts = df.agg(F.count_if(unit).alias("unit_issues"), F.count_if(buffered).alias("buffer_conflicts"))
    q = exact_quantiles(df.filter(group), [], area, {"median_all": 0.5})
    qc = exact_quantiles(df.filter(group & core), [], area, {"median_core": 0.5})
    return (
        counts.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(qc))
        .withColumn("core_smaller", F.col("median_core") < 0.5 * F.col("median_all"))
    )


def flag_outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Add the group's 3 x IQR fences to every row."""
    q = exact_quantiles(df, [key], value, {"_a": 0.25, "_b": 0.75})
    iqr = F.col("_b") - F.col("_a")
    fences = q.select(
        key, F.greatest(F.col("_a") - 3 * iqr, F.lit(0.0)).alias("fence_low"), (F.col("_b") + 3 * iqr).alias("fence_high")
    )
    return df.join(fences, key, "left")


def coverage(df: DataFrame, keys: Sequence[str], covered: Column, amount: str) -> DataFrame:
    """Share of covered rows and mean amount over covered rows."""
    return df.groupBy(*keys).agg(
        F.avg(covered.cast("double")).alias("coverage_rate"),
        F.avg(F.when(covered, F.col(amount))).alias("avg_amount"),
    )


def count_flags(df: DataFrame, count: str, out: str, sparse: int, high: str) -> DataFrame:
    """Quality flag of a count column; later rules override: valid, zero, sparse, high."""
    c = F.col(count)
    return df.withColumn(
        out,
        F.when(c > F.col(high), "high_outlier").when((c > 0) & (c <= sparse), "sparse")
        .when(c == 0, "zero_excluded").otherwise("valid"),
    )


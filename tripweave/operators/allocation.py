"""Proportional allocation and statistics of grouped (binned) data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.lookup import with_group_stats


def allocate(df: DataFrame, group: str, part: str, values: Sequence[str], digits: int | None = 4) -> DataFrame:
    """Split group-level ``values`` over members in proportion to ``part``.

    A group whose parts sum to 0 gets weight 0.
    """
    df = with_group_stats(df, [group], _total=F.sum(part))
    weight = F.when(F.col("_total") > 0, F.col(part) / F.col("_total")).otherwise(0.0)
    df = df.withColumn("weight", weight)
    for v in values:
        share = F.col(v) * F.col("weight")
        df = df.withColumn(v, F.bround(share, digits) if digits is not None else share)
    return df.drop("_total")


def grouped_mean(counts: Mapping[str, float]) -> Column:
    """Mean of binned data from a wide row: class column -> midpoint. No members gives NULL."""
    total, members = F.lit(0.0), F.lit(0.0)
    for c, mid in counts.items():
        n = F.coalesce(F.col(c), F.lit(0))
        total = total + n * float(mid)
        members = members + n
    return F.bround(F.try_divide(total, members), 2)


def cumulative_counts(df: DataFrame, keys: Sequence[str], class_id: str, n: str) -> DataFrame:
    """Running and total counts over ordered classes; one row per key and class."""
    by_class = Window.partitionBy(*keys).orderBy(class_id).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_n", F.sum(n).over(by_class)).withColumn("total_n", F.sum(n).over(Window.partitionBy(*keys)))


def grouped_median(df: DataFrame, keys: Sequence[str], class_id: str, lower: str, width: str,
                   n: str, is_open: str) -> DataFrame:
    """Median of binned data: ``L + ((N/2 - CF) / f) * w`` in the first class reaching N/2.

    One row per key: ``median`` and ``median_open`` (true when it falls in the open class,
    with a NULL median). No members gives NULL.
    """
    reached = cumulative_counts(df, keys, class_id, n).filter(F.col("cum_n") >= F.col("total_n") / 2)
    inside = F.try_divide(F.col("total_n") / 2 - (F.col("cum_n") - F.col(n)), F.col(n))
    first = reached.groupBy(*keys).agg(
        F.min_by(
            F.struct(
                F.when(~F.col(is_open), F.bround(F.col(lower) + inside * F.col(width), 2)).alias("median"),
                F.col(is_open).alias("median_open"),
            ),
            class_id,
        ).alias("_m")
    )
    return first.select(*keys, "_m.median", "_m.median_open")

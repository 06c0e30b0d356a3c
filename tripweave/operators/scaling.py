"""Scalers. Global ones use a one-row aggregate, grouped ones an aggregate joined back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators.lookup import with_group_stats
from tripweave.operators.quantiles import column_quantiles, exact_quantiles


def min_max(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), constant: float = 0.5) -> DataFrame:
    """Scale to [0, 1]; a constant column or group becomes ``constant``."""
    df = with_group_stats(df, keys, _lo=F.min(value), _hi=F.max(value))
    scaled = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.withColumn(
        out, F.when(F.col(value).isNull(), None).when(F.col("_hi") == F.col("_lo"), float(constant)).otherwise(scaled)
    ).drop("_lo", "_hi")


def min_max_many(df: DataFrame, cols: Mapping[str, str], constant: float = 0.5) -> DataFrame:
    """Scale several whole columns (value -> new name) to [0, 1] from one aggregate."""
    bounds = df.agg(*[f(c).alias(f"_{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))])
    joined = df.crossJoin(F.broadcast(bounds))
    for c, out in cols.items():
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = F.when(F.col(c).isNull(), None).when(high == low, float(constant)).otherwise(F.try_divide(F.col(c) - low, high - low))
        joined = joined.withColumn(out, scaled)
    return joined.drop(*[f"_{p}_{c}" for c in cols for p in ("lo", "hi")])


def z_scores(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Standardise with the population sd over rows complete in all ``cols``.

    Incomplete rows get NULL; a constant column gives 0.
    """
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    stats = df.filter(complete).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    df = df.crossJoin(F.broadcast(stats))
    for c in cols:
        z = F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
        df = df.withColumn(c + suffix, F.when(complete, z))
    return df.drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def robust_z(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - median) / IQR over the whole column; IQR 0 gives 0."""
    q = exact_quantiles(df, [], value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    spread = F.col("_q3") - F.col("_q1")
    z = F.when(spread == 0, 0.0).otherwise(F.try_divide(F.col(value) - F.col("_q2"), spread))
    return df.crossJoin(F.broadcast(q)).withColumn(out, z).drop("_q1", "_q2", "_q3")


def robust_z_many(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """``robust_z`` of several columns (value -> new name): all quantiles from one unpivoted table."""
    q = column_quantiles(df, list(cols), {"1": 0.25, "2": 0.5, "3": 0.75})
    joined = df.crossJoin(F.broadcast(q))
    for c, out in cols.items():
        low, middle, high = (F.col(f"_q{i}_{c}") for i in "123")
        joined = joined.withColumn(out, F.when(high == low, 0.0).otherwise(F.try_divide(F.col(c) - middle, high - low)))
    return joined.drop(*[f"_q{i}_{c}" for c in cols for i in "123"])

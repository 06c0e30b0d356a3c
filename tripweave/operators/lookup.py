"""Joins: lookups, fallbacks, semi and anti filters, staged matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.text import norm_key


def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A lookup written in code as a table; the optimizer knows its size and picks the join."""
    return spark.createDataFrame(list(rows), schema)


def left_lookup(df: DataFrame, other: DataFrame, on: Mapping[str, str], take: Sequence[str]) -> DataFrame:
    """Left join on differently named keys; only ``take`` columns come across.

    No hint is given: the optimizer broadcasts ``other`` when its size allows.
    """
    side = other.select(*[F.col(r).alias(f"_key_{l}") for l, r in on.items()], *take)
    condition = [F.col(l) == F.col(f"_key_{l}") for l in on]
    return df.join(side, condition, "left").drop(*[f"_key_{l}" for l in on])


def inner_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str],
                   suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Inner join; non-key columns present on both sides get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(on))


def fallback_key(df: DataFrame, key: str, other: DataFrame, other_key: str,
                 out: str = "match_key", fallback: str = "Others") -> DataFrame:
    """Add ``out``: the key when ``other`` lists it, else the fallback group's name."""
    listed = (
        other.select(F.col(other_key).alias("_listed"))
        .filter(F.lower("_listed") != fallback.lower())
        .distinct()
    )
    return (
        df.join(listed, F.col(key) == F.col("_listed"), "left")
        .withColumn(out, F.coalesce("_listed", F.lit(fallback)))
        .drop("_listed")
    )


def keep_listed(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(*on), list(on), "left_semi")


def drop_listed(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``ids``."""
    return df.join(ids.select(*on), list(on), "left_anti")


def last_state(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Latest ``state`` per key by ``order``: an aggregate, so it combines map-side."""
    return log.groupBy(key).agg(F.max_by(state, order).alias(state))


def still_to_do(work: DataFrame, log: DataFrame, key: str, order: str, state: str, done: str = "ok") -> DataFrame:
    """Work whose last logged state is not ``done``."""
    finished = last_state(log, key, order, state).filter(F.col(state) == done)
    return drop_listed(work, finished, [key])


def sector_lookup(df: DataFrame, postal: str, sectors: DataFrame, code: str, area: str, stats: DataFrame, stats_area: str, take: Sequence[str]) -> DataFrame:
    """Add ``sector`` (the first two characters of a postal code) and the columns ``take`` of the sector's area.

    ``sectors`` has a code and an area, ``stats`` one row an area; areas match whatever their case and
    outer blanks. An unknown sector or area leaves NULL.
    """
    keyed = df.withColumn("sector", F.substring(F.col(postal), 1, 2))
    named = sectors.select(F.col(code).alias("_code"), norm_key(F.col(area)).alias("_area"))
    placed = left_lookup(keyed, named, {"sector": "_code"}, ["_area"])
    known = stats.select(norm_key(F.col(stats_area)).alias("_name"), *take)
    return left_lookup(placed, known, {"_area": "_name"}, list(take)).select(*df.columns, "sector", *take)


def still_incomplete(work: DataFrame, done: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Work not yet present in ``done`` with every required column filled."""
    return drop_listed(work, done.dropna(subset=list(required)), [key])


def probe_all(df: DataFrame, probes: DataFrame, slices: int | None = None) -> DataFrame:
    """Every row with every probe: an origins x destinations table.

    The probes are cut into hashed slices (four a core by default) and each row is sent to
    every slice, so both sides stay partitioned at any size; the optimizer broadcasts
    the probes instead when its own limit allows.
    """
    slices = slices or df.sparkSession.sparkContext.defaultParallelism * 4
    right = probes.withColumn("_slice", F.pmod(F.xxhash64(*probes.columns), F.lit(slices)).cast("int"))
    left = df.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.join(right, "_slice").drop("_slice")


def group_prior(df: DataFrame, priors: DataFrame, on: str, value: str, out: str) -> DataFrame:
    """Value of the row's group, else the mean over groups (``priors`` holds one row per group)."""
    overall = priors.agg(F.avg(value).alias("_overall"))
    side = priors.select(F.col(on).alias("_group"), F.col(value).alias("_value"))
    return (
        df.join(side, F.col(on) == F.col("_group"), "left")
        .crossJoin(F.broadcast(overall))
        .withColumn(out, F.coalesce("_value", "_overall"))
        .drop("_group", "_value", "_overall")
    )


def apply_decisions(df: DataFrame, decisions: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Overwrite ``cols`` where the decision table has a value for the row's key."""
    side = decisions.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(side, key, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    return joined.drop(*[f"_new_{c}" for c in cols])


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group aggregates on every row.

    Aggregate-and-join instead of a window: the aggregate combines before its shuffle, so
    a hot key never gathers in one task, and the join splits skewed keys at run time. ``df``
    is read twice: store it first (``cut_lineage``) when it is costly to compute.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    if not keys:
        return df.crossJoin(F.broadcast(totals))
    side = totals.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(side, condition, "left").drop(*[f"_g_{k}" for k in keys])

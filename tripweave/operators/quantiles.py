"""Exact quantiles and running totals that never put one group into one task.

Values are first counted (map-side), then cut into value ranges. Only range totals,
one row per group and range, are ever ordered together; ordering inside a range is
spread over the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.session import cut_lineage

#: No task orders more rows than a range holds. The first cut makes FEWEST_RANGES to FIRST_RANGES ranges;
#: ranges with more than RANGE_ROWS rows are cut into SPLIT parts again, until there are none.
RANGE_ROWS, FEWEST_RANGES, FIRST_RANGES, SPLIT = 250_000, 16, 64, 32


def _cuts(df: DataFrame, value: str, ranges: int | None) -> list[float]:
    """Approximate range borders, as many as the rows ask for. They only balance work, so borders
    at infinity are left out: infinite values fall into the outer ranges."""
    fine = [i / FIRST_RANGES for i in range(1, FIRST_RANGES)]
    sketch = F.percentile_approx(F.col(value).cast("double"), fine, 4 * FIRST_RANGES).alias("c")
    row = df.agg(sketch, F.count(value).alias("n")).first()
    wanted = ranges or min(FIRST_RANGES, max(FEWEST_RANGES, row["n"] // RANGE_ROWS))
    found = row["c"] or []
    picked = {found[round(i * len(found) / wanted)] for i in range(1, wanted) if round(i * len(found) / wanted) < len(found)}
    return sorted(c for c in picked if math.isfinite(c))


def _range_of(value: str, cuts: Sequence[float]):
    """Index of the range holding a column's value, as a long: a balanced CASE tree over the borders."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return f"{low}L"
        mid = (low + high) // 2
        return f"CASE WHEN `{value}` < {float(cuts[mid])!r}D THEN {tree(low, mid)} ELSE {tree(mid + 1, high)} END"

    return F.expr(tree(0, len(cuts)))


def refine_ranges(df: DataFrame, keys: Sequence[str], value: str, most: int | None = None) -> DataFrame:
    """Split the ranges (``keys`` and ``_range``) of more than ``most`` rows at sketched quantiles of their own,
    again and again until none is left. ``value`` must be distinct within ``keys``; ranges keep their order.

    Each round reads one small row a crowded range; only those ranges are sketched. ``df`` must be stored.
    """
    most = most or RANGE_ROWS
    cell = [*keys, "_range"]
    points = [i / SPLIT for i in range(1, SPLIT)]
    while True:
        crowded = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most).select(*cell)
        crowded = cut_lineage(crowded, compact=True)
        if crowded.isEmpty():
            return df
        sketch = F.percentile_approx(F.col(value).cast("double"), points, 8 * SPLIT)
        cuts = df.join(crowded, cell, "left_semi").groupBy(*cell).agg(sketch.alias("_borders"))
        part = F.size(F.filter(F.array_distinct("_borders"), lambda b: b <= F.col(value).cast("double")))
        df = cut_lineage(
            df.join(cut_lineage(cuts, compact=True), cell, "left")
            .withColumn("_range", F.col("_range") * (SPLIT + 1) + F.when(F.col("_borders").isNull(), 0).otherwise(part))
            .drop("_borders")
        )


def running_total(df: DataFrame, keys: Sequence[str], order: str, amount: str, out: str,
                  ranges: int | None = None) -> DataFrame:
    """Add ``out``: running sum of ``amount`` by rising ``order`` within ``keys``, own row
    included, and ``out_total``: the sum over the group.

    ``order`` must be numeric and distinct within ``keys``, as after a group by. Rows with a
    NULL key are dropped. ``df`` is read three times, so it should be a stored table.
    """
    keys = list(keys)
    df = refine_ranges(df.withColumn("_range", _range_of(order, _cuts(df, order, ranges))), keys, order)
    return _running(df, keys, order, amount, out)


def _running(df: DataFrame, keys: list[str], order: str, amount: str, out: str) -> DataFrame:
    """``running_total`` of rows that have their ``_range``."""
    totals = df.groupBy(*keys, "_range").agg(F.sum(amount).alias("_in_range"))
    by_range = Window.partitionBy(*keys).orderBy("_range")
    everything = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_range",
        (F.sum("_in_range").over(by_range) - F.col("_in_range")).alias("_before"),
        F.sum("_in_range").over(everything).alias(f"{out}_total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_before") + F.sum(amount).over(inside))
        .drop("_range", "_before")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], ranges: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per ``keys``, one column per name.

    Equal to ``percentile`` on the same rows, NULLs and NULL keys skipped; a group may hold
    any share of the data. Rows are first only counted per group and value range, which
    combines map-side. Then just the values of the ranges that hold a wanted rank are counted, and their
    ranges are cut again while they hold more than RANGE_ROWS of them, so any number of rows is ordered
    in tasks of that size. ``df`` is read three times: store it first when it is costly to compute.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=[*keys, "_v"])
    base = base.withColumn("_range", _range_of("_v", _cuts(base, "_v", ranges)))
    totals = base.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    by_range, everything = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    placed = totals.withColumn("_before", F.sum("_c").over(by_range) - F.col("_c")).withColumn("_all", F.sum("_c").over(everything))
    ranks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_all") - 1)
        low = F.floor(position)
        ranks += [
            F.struct(F.lit(f"{name}<").alias("side"), F.lit(1.0).alias("part"), low.alias("rank")),
            F.struct(F.lit(f"{name}>").alias("side"), (position - low).alias("part"), (low + 1).alias("rank")),
        ]
    wanted = placed.select(*keys, "_range", "_before", "_c", F.inline(F.array(*ranks))).select(
        *keys, "_range", "side", "part", (F.col("rank") - F.col("_before")).alias("_at"), "_c"
    ).filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_c")) & (F.col("part") > 0)).drop("_c")
    # a few ranks per group and range
    spots = cut_lineage(wanted.groupBy(*keys, "_range").agg(F.collect_list(F.struct("side", "part", "_at")).alias("_spots")))
    near = base.join(spots.select(*keys, "_range"), [*keys, "_range"], "left_semi")
    counted = cut_lineage(near.groupBy(*keys, F.col("_range").alias("_cell"), "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.lit(0).cast("long")))
    cells = [*keys, "_cell"]
    ran = _running(refine_ranges(counted, cells, "_v"), cells, "_v", "_n", "_upto").join(spots.withColumnRenamed("_range", "_cell"), cells)
    mine = F.filter("_spots", lambda w: (w["_at"] < F.col("_upto")) & (w["_at"] >= F.col("_upto") - F.col("_n")))
    hits = ran.select(*keys, "_v", F.inline(mine))
    found = hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == f"{n}{s}", F.struct("_v", "part"))).alias(f"{n}{s}") for n in probs for s in "<>"]
    )

    def between(n: str):
        low, high = F.col(f"`{n}<`._v"), F.col(f"`{n}>`")
        mixed = F.when(high["_v"] == low, low).otherwise(low + (high["_v"] - low) * high["part"])  # equal: may be infinite
        return F.coalesce(mixed, low).alias(n)

    return found.select(*keys, *[between(n) for n in probs])


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of several columns in one run: one row, columns ``_q<name>_<column>``."""
    long = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_column", "_value").dropna())
    found = exact_quantiles(long, ["_column"], "_value", probs)
    return found.agg(*[F.max(F.when(F.col("_column") == c, F.col(n))).alias(f"_q{n}_{c}") for c in cols for n in probs])


def average_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add the average rank (ties share it) of ``value`` over ``keys``; NULL for NULL."""
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranks = running_total(cut_lineage(counted), keys, "_v", "_n", "_upto", ranges).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        "_v",
        (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out),
    )
    match = F.col(value) == F.col("_v")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, match, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])

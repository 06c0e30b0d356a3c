"""Appending, pivoting and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_all(*frames: DataFrame) -> DataFrame:
    """Stack tables with different columns; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` not in ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found in both."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def wide_to_long(df: DataFrame, keys: Sequence[str], cols: Mapping[str, tuple], names: Sequence[str], value: str) -> DataFrame:
    """One row per column: ``cols`` maps a column to its (name, ...) labels, one per ``names``."""
    cells = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(names, labels)], F.col(f"`{c}`").cast("double").alias(value))
            for c, labels in cols.items()
        ]
    )
    return df.select(*keys, F.inline(cells))


def long_to_wide(df: DataFrame, key: str, by: str, levels: Sequence, value: str, fill=None, prefix: str = "alt_") -> DataFrame:
    """One row per key, one column per level, gaps filled."""
    wide = df.groupBy(key).agg(
        *[F.max(F.when(F.col(by) == lv, F.col(value))).alias(f"{prefix}{lv}") for lv in levels]
    )
    return wide if fill is None else wide.fillna(fill)


def chosen_position(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """0-based position of the largest of several columns, first on a tie."""
    values = F.array(*[F.col(c) for c in cols])
    return df.withColumn(out, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Add literal columns."""
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def attribute_records(sources: Mapping[str, tuple[DataFrame, Mapping[str, Column], Mapping[str, object]]]) -> DataFrame:
    """Union of records from several sources.

    Each source is (table, selected columns, constants); the key says the id prefix.
    """
    from tripweave.functions.text import surrogate_key

    frames = []
    for prefix, (table, picked, constants) in sources.items():
        rows = with_constants(table.select(*[c.alias(n) for n, c in picked.items()]), constants)
        frames.append(rows.withColumn("poi_id", surrogate_key(prefix, *[F.col(n).cast("string") for n in picked])))
    return append_all(*frames)

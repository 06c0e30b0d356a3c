"""Header and projection helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Columns of ``wanted`` that exist, in that order."""
    return df.select([c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail before any job runs."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coalesce_names(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first synonym present to the standard name."""
    renames = {}
    for target, names in synonyms.items():
        first = next((n for n in names if n in df.columns), None)
        if first and first != target:
            renames[first] = target
    return df.withColumnsRenamed(renames)


def normalise_headers(df: DataFrame, lower: bool = True) -> DataFrame:
    """Trim (and lower-case) every header."""
    return df.toDF(*[c.strip().lower() if lower else c.strip() for c in df.columns])


def rename_map(df: DataFrame, mapping: Mapping[str, str], first: str | None = None) -> DataFrame:
    """Rename by name; ``first`` renames the first column whatever it is called."""
    if first is not None:
        df = df.withColumnRenamed(df.columns[0], first)
    return df.withColumnsRenamed(dict(mapping))


def fill_with_median(df: DataFrame, *cols: str) -> DataFrame:
    """Replace NULLs by the column's exact median (a one-row side joined to every row)."""
    from tripweave.operators.quantiles import column_quantiles

    medians = column_quantiles(df, cols, {"2": 0.5})
    filled = df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col(f"_q2_{c}")) for c in cols})
    return filled.drop(*[f"_q2_{c}" for c in cols])

"""Row filters that say what they drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_equal_text(df: DataFrame, col: str, value: str) -> DataFrame:
    """Drop rows whose trimmed, lower-cased text equals ``value``; NULL rows stay."""
    same = F.lower(F.trim(F.col(col))) == value.lower()
    return df.filter(F.coalesce(~same, F.lit(True)))


def keep_non_negative(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where every column is present and at least 0."""
    for c in cols:
        df = df.filter(F.col(c) >= 0)
    return df


def is_true_text(c: Column) -> Column:
    """``1`` / ``true`` in any case, from text, number or boolean."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "1.0"), F.lit(False))


def is_clear_status(c: Column) -> Column:
    """Status text that means no error; NULL counts as clear."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin("OK", "NAN", "0", "NONE", ""), F.lit(True))


def category_match(subtype: Column, tags: Mapping[str, Column],
                   rules: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """True when any tag rule of the subtype holds; a subtype without rules keeps all."""
    name = F.lower(subtype)
    out = None
    for kind, by_tag in rules.items():
        hit = F.lit(False)
        for tag, values in by_tag.items():
            if tag in tags:
                hit = hit | F.coalesce(tags[tag].isin(list(values)), F.lit(False))
        out = F.when(name == kind, hit) if out is None else out.when(name == kind, hit)
    return F.lit(True) if out is None else out.otherwise(True)


def screen(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Apply screening rules in order.

    Returns the kept rows and the attrition table (step, rule, kept), both lazy; the
    counts come from one pass with a running AND of the rules.
    """
    passed, running = {}, F.lit(True)
    for name, rule in rules.items():
        running = running & F.coalesce(rule, F.lit(False))
        passed[name] = running
    kept = df.filter(running)
    counts = df.agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(c).alias(n) for n, c in passed.items()]
    )
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"`{n}`").alias("kept"))
            for i, n in enumerate(["all", *passed])
        ]
    )
    return kept, counts.select(F.inline(steps))


def reject_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reason``: the first rule that is true, NULL for a good row."""
    out = None
    for name, bad in rules.items():
        hit = F.coalesce(bad, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.withColumn("reason", out)

"""Numeric columns: knots, buckets, codes, composites, flags and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate, chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def piecewise_interpolate(
    x: Column,
    xp: Sequence[float],
    fp: Sequence[float],
    monotone: bool = False,
    clip: bool = True,
) -> Column:
    """Linear interpolation through knots as one CASE, so it stays in codegen.

    ``monotone`` replaces ``fp`` by its running maximum. Outside the knots the end
    values hold with ``clip``; without it the result is NULL there.
    """
    if len(xp) != len(fp) or len(xp) < 2:
        raise ValueError("xp and fp need the same length, at least 2")
    if any(b <= a for a, b in zip(xp, xp[1:])):
        raise ValueError("xp must rise strictly")
    ys = list(accumulate(fp, max)) if monotone else list(fp)
    low, high = (F.lit(float(ys[0])), F.lit(float(ys[-1]))) if clip else (F.lit(None), F.lit(None))
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x < F.lit(float(xp[0])), low)
    for x0, x1, y0, y1 in zip(xp, xp[1:], ys, ys[1:]):
        slope = (y1 - y0) / (x1 - x0)
        out = out.when(x <= F.lit(float(x1)), F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope))
    return out.otherwise(high)


def bucket_value(x: Column, edges: Sequence[float], values: Sequence[float]) -> Column:
    """Value of the left-closed bucket holding ``x``, ends clipped; NULL in, NULL out."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for upper, value in zip(edges[1:], values[:-1]):
        out = out.when(x < F.lit(float(upper)), F.lit(float(value)))
    return out.otherwise(F.lit(float(values[-1])))


def code_map(c: Column, mapping: Mapping, default=None) -> Column:
    """Look a code up in a small literal map."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(literal, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def flag_in(c: Column, members: Sequence) -> Column:
    """1 when the value is a member, else 0 (also for NULL)."""
    return F.when(c.isin(list(members)), 1).otherwise(0)


def clip(c: Column, low=None, high=None) -> Column:
    """Bound a column, keeping NULL as NULL."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def within_or_null(c: Column, low, high) -> Column:
    """Keep values inside the closed range, NULL the rest."""
    return F.when(c.between(low, high), c)


def reverse_score(c: Column, scale_max: int = 5) -> Column:
    """Reverse a 1..max item."""
    return F.lit(scale_max + 1) - c


def pivot_level(baseline: Column, level: Column, deltas: Mapping[int, float]) -> Column:
    """Baseline plus the delta of a design level, two decimals half-even, NULL-safe."""
    shift = code_map(level.cast("int"), {int(k): float(v) for k, v in deltas.items()}, 0.0)
    return F.when(level.isNotNull(), F.bround(baseline + shift, 2))


def level_dummies(level: Column) -> dict[str, Column]:
    """Two 0/1 columns from a 0/1/2 size scale; unknown counts as small."""
    return {
        "D_med": F.when(level.cast("int") == 1, 1).otherwise(0),
        "D_lrg": F.when(level.cast("int") == 2, 1).otherwise(0),
    }


def composite(weights: Mapping[str, float]) -> Column:
    """Weighted sum of columns."""
    terms = [F.lit(float(w)) * F.col(c) for c, w in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def flag_range(x: Column, limits: Sequence[Column], fences: Sequence[Column] | None = None) -> Column:
    """Threshold flags of a value: ``struct<flags, max_severity, flag_count>``.

    ``limits`` is (min, typical_min, typical_max, max). Outside min/max is severity 3,
    outside the typical range 2, outside the optional statistical ``fences`` 1.
    """
    low, typical_low, typical_high, high = limits
    marks = [
        F.when(x < low, F.struct(F.lit("below minimum").alias("text"), F.lit(3).alias("severity")))
        .when(x < typical_low, F.struct(F.lit("below typical").alias("text"), F.lit(2).alias("severity"))),
        F.when(x > high, F.struct(F.lit("above maximum").alias("text"), F.lit(3).alias("severity")))
        .when(x > typical_high, F.struct(F.lit("above typical").alias("text"), F.lit(2).alias("severity"))),
    ]
    if fences:
        marks.append(F.when(x < fences[0], F.struct(F.lit("low outlier").alias("text"), F.lit(1).alias("severity"))))
        marks.append(F.when(x > fences[1], F.struct(F.lit("high outlier").alias("text"), F.lit(1).alias("severity"))))
    found = F.array_compact(F.array(*marks))
    return F.struct(
        F.array_join(F.transform(found, lambda m: m["text"]), " | ").alias("flags"),
        F.array_max(F.transform(found, lambda m: m["severity"])).alias("max_severity"),
        F.size(found).alias("flag_count"),
    )


def significance(p: Column) -> Column:
    """Stars for a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.10, ".").otherwise("")


def sign_verdict(p_positive: Column) -> Column:
    """Label of the probability that an effect is positive."""
    return F.when(p_positive > 0.90, "positive").when(p_positive < 0.10, "negative").otherwise("uncertain")


def row_mean(*cols: Column) -> Column:
    """Mean over columns of one row, NULLs skipped; all NULL gives NULL."""
    present = F.array_compact(F.array(*[c.cast("double") for c in cols]))
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v), F.size(present))

"""Run the place scores, or any scoring function, over a parameter grid and judge robustness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.dates import decay_weight
from tripweave.operators.perception import image_weights, shrink
from tripweave.operators.posterior import parameter_grid, robustness


def run_grid(spark, score: Callable[..., DataFrame]) -> DataFrame:
    """Stack ``score(half_life, kappa, alpha)`` over the grid's few rows, tagged.

    ``score`` returns (parameter, mean, sd, significant). The grid is a handful of rows,
    each a separate plan.
    """
    grid = parameter_grid(spark)
    names = [c for c in grid.columns if c not in ("tag", "varied_param")]
    runs = [
        score(**{n: r[n] for n in names}).withColumn("tag", F.lit(r["tag"])).withColumn("varied_param", F.lit(r["varied_param"]))
        for r in grid.toLocalIterator()
    ]
    return reduce(lambda a, b: a.unionByName(b), runs)


def score_grid(images: DataFrame, places: DataFrame, as_of, dims: Sequence[str], base: Mapping[str, float] = K.BASE_PARAMETERS,
               grid: Mapping[str, Sequence[float]] = K.PARAMETER_GRID) -> DataFrame:
    """Final scores of every place under every grid row, as ``score_places`` gives them, in one plan.

    Images are read once and summed by place, age and view, which no grid row changes; only those
    sums meet the half-lives, and only places meet the whole grid, a few rows made here. Returns the
    columns of ``places``, the grid's (tag, varied_param, half_life, kappa, alpha), n_images, n_eff,
    aggregation_method and the means, priors and scores. A NULL score drops out of its own mean
    only; places without usable images get their prior.
    """
    runs = parameter_grid(images.sparkSession, base, grid)
    alike = image_weights(images, as_of).groupBy("poi_id", "age_days", "w_view").agg(
        F.count(F.lit(1)).alias("n"), *[f(d).alias(f"_{p}_{d}") for d in dims for p, f in (("sum", F.sum), ("n", F.count))]
    )
    aged = alike.crossJoin(F.broadcast(runs.select("half_life").distinct()))
    w, n = F.col("_w"), F.col("n")
    stats = aged.withColumn("_w", decay_weight(F.col("age_days"), F.col("half_life")) * F.col("w_view")).groupBy("poi_id", "half_life").agg(
        F.sum(n).alias("n_images"), (F.sum(w * n) * F.sum(w * n) / F.nullif(F.sum(w * w * n), F.lit(0.0))).alias("n_eff"),
        *[F.try_divide(F.sum(w * F.col(f"_sum_{d}")), F.sum(F.when(F.col(f"_n_{d}") > 0, w * F.col(f"_n_{d}")))).alias(f"{d}_mean") for d in dims],
    )
    return shrink(places.crossJoin(F.broadcast(runs)), stats, "poi_id", dims, "subtype", "planning_area",
                  F.col("alpha"), F.col("kappa"), by=["tag", "half_life"])


def score_effects(scores: DataFrame, outcome: str, dims: Sequence[str], z: float = 1.96) -> DataFrame:
    """Slope of ``outcome`` on each score in each run: (tag, varied_param, parameter, mean, sd, significant).

    One aggregate over all runs; pairs with a NULL drop out, and a score without spread, or fewer than
    three places, gives NULL.
    """
    y = F.col(outcome)
    fits = []
    for d in dims:
        x = F.col(d)
        slope, rest = F.regr_slope(y, x), F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
        free = F.nullif(F.greatest(F.regr_count(y, x) - 2, F.lit(0)), F.lit(0))
        sd = F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)) / free, F.regr_sxx(y, x)))
        fits.append(F.struct(F.lit(d).alias("parameter"), slope.alias("mean"), sd.alias("sd"), (F.abs(slope) > z * sd).alias("significant")))
    return scores.groupBy("tag", "varied_param").agg(F.array(*fits).alias("_fits")).select("tag", "varied_param", F.inline("_fits"))


def judge(runs: DataFrame) -> DataFrame:
    """Robustness verdict per parameter."""
    return robustness(runs)

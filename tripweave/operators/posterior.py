"""Tables of posterior draws, convergence summaries and sensitivity runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.numeric import sign_verdict
from tripweave.operators.aggregates import metric_rows
from tripweave.operators.quantiles import exact_quantiles


def draws_summary(draws: DataFrame, param: str = "param", value: str = "value") -> DataFrame:
    """Mean, population sd, 3/97 percentiles, P(>0), sign verdict and interval verdict."""
    base = draws.groupBy(param).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.avg((F.col(value) > 0).cast("double")).alias("p_positive"),
    )
    q = exact_quantiles(draws, [param], value, {"hdi_3": 0.03, "hdi_97": 0.97})
    return base.join(q, param).withColumn("verdict", sign_verdict(F.col("p_positive"))).withColumn(
        "significant", (F.col("hdi_3") > 0) | (F.col("hdi_97") < 0)
    )


def convergence_counts(summary: DataFrame) -> DataFrame:
    """How many parameters miss the R-hat and effective-sample marks."""
    return metric_rows(
        summary,
        {"rhat over 1.05": F.count_if(F.col("r_hat") > 1.05), "rhat over 1.01": F.count_if(F.col("r_hat") > 1.01),
         "ess below 400": F.count_if(F.col("ess_bulk") < 400)},
        "check",
    )


def parameter_grid(spark: SparkSession, base: Mapping[str, float] = K.BASE_PARAMETERS,
                   grid: Mapping[str, Sequence[float]] = K.PARAMETER_GRID) -> DataFrame:
    """Baseline plus one-at-a-time variations: tag, varied_param and the parameters."""

    def tag(row: Mapping[str, float]) -> str:
        return "_".join(f"{k}{str(v).replace('.', '')}" for k, v in row.items())

    runs = {tag(base): ("baseline", dict(base))}
    for name, values in grid.items():
        for v in values:
            row = {**base, name: v}
            runs.setdefault(tag(row), (name, row))
    rows = [(t, varied, *[float(v) for v in row.values()]) for t, (varied, row) in runs.items()]
    return spark.createDataFrame(rows, "tag string, varied_param string, " + ", ".join(f"{k} double" for k in base))


def robustness(runs: DataFrame) -> DataFrame:
    """Per parameter: largest shift from the baseline mean, verdict stability, robust or not.

    ``runs`` is (tag, varied_param, parameter, mean, sd, significant).
    """
    base = runs.filter(F.col("varied_param") == "baseline").select(
        "parameter", F.col("mean").alias("base_mean"), F.col("sd").alias("base_sd"), F.col("significant").alias("base_sig")
    )
    stats = runs.join(base, "parameter").groupBy("parameter", "base_mean", "base_sd").agg(
        F.max(F.abs(F.col("mean") - F.col("base_mean"))).alias("max_shift"),
        F.bool_and(F.col("significant") == F.col("base_sig")).alias("verdict_stable"),
    )
    return stats.withColumn("robust", F.col("verdict_stable") & (F.col("max_shift") < F.col("base_sd")))

"""From survey choices and counts to joint estimates: each fit hands its estimates on as priors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tripweave.operators import choice_models as cm
from tripweave.operators.tails import normal_two_sided

WIDTH = 1.96


def person_terms(attitudes: Mapping[str, str], alternatives: Sequence) -> dict[str, tuple[str, list]]:
    """Terms of person-level columns (name -> column): they enter the given alternatives only, as
    what does not differ between alternatives cannot enter all."""
    return {name: (column, list(alternatives)) for name, column in attitudes.items()}


def final_table(spark, fit: cm.Fit, choice_names: Sequence[str], features: Sequence[str]) -> DataFrame:
    """parameter, layer, mean, sd, low, high, p_positive, converged: the normal posterior of a MAP fit."""
    rows = []
    for name, b, v in zip(fit.names, fit.beta, fit.covariance.diagonal()):
        sd = float(v) ** 0.5
        tail = normal_two_sided(float(b) / sd) / 2
        layer = "shared" if name in choice_names and name in features else "choice" if name in choice_names else "count"
        rows.append((name, layer, float(b), sd, float(b) - WIDTH * sd, float(b) + WIDTH * sd, 1 - tail if b > 0 else tail, fit.converged))
    return spark.createDataFrame(rows, "parameter string, layer string, mean double, sd double, low double, high double, p_positive double, converged boolean")


def run(
    arrays: DataFrame, choice_names: Sequence[str], n_alts: int, counts: DataFrame, features: Sequence[str], weak: Mapping[str, tuple[float, float]],
) -> dict[str, DataFrame]:
    """Tables ``choice``, ``handover`` and ``final``.

    The choice model's estimates are the priors of the count model's coefficients of the same
    name; others take ``weak``. In the joint fit a coefficient of both lists is one parameter. Both
    data sets enter it as data, so it takes ``weak`` priors again: no observation counts twice.
    """
    spark = arrays.sparkSession
    choice = cm.fit_logit(arrays, choice_names, n_alts)
    survey = cm.prior_table(spark, choice, "survey")
    shared = [f for f in features if f in choice_names]
    count = cm.fit_counts(counts, features, {**weak, **cm.priors_from(survey, shared)})
    handover = cm.prior_table(spark, count, "counts")
    joint = cm.fit_joint(arrays, choice_names, n_alts, counts, features, weak)
    return {"choice": choice.table(spark), "handover": survey.unionByName(handover), "final": final_table(spark, joint, choice_names, features)}

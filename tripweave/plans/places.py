"""Image scores to place scores: weights, weighted moments, shrinkage, robust scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.numeric import composite
from tripweave.operators.aggregates import weighted_moments
from tripweave.operators.perception import image_weights, shrink
from tripweave.operators.quantiles import exact_quantiles
from tripweave.operators.scaling import min_max_many, robust_z_many
from tripweave.session import cut_lineage

DIMENSIONS = list(K.DIMENSION_WEIGHTS)


def dimensions(features: DataFrame, scale: bool = True) -> DataFrame:
    """The five composite dimensions and their min-max scaled copies."""
    df = features.withColumns({d: composite(w) for d, w in K.DIMENSION_WEIGHTS.items()})
    if scale:
        df = min_max_many(df, {d: f"{d}_std" for d in DIMENSIONS}, constant=0.0)
    return df


def place_stats(weighted: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """Counts, exact median age, weight sums and weighted moments per place."""
    base = weighted.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("w_view") == 1.0).alias("n_panos"),
        F.min("age_days").alias("min_image_age"), F.max("age_days").alias("max_image_age"),
    )
    ages = exact_quantiles(weighted, [key], "age_days", {"median_image_age": 0.5})
    return base.join(ages, key).join(weighted_moments(weighted, [key], "weight", dims), key)


def score_places(images: DataFrame, places: DataFrame, as_of, dims: Sequence[str] = DIMENSIONS,
                 half_life: float = K.HALF_LIFE_DAYS, mix: float = K.PRIOR_MIX, strength: float = K.PRIOR_STRENGTH) -> DataFrame:
    """Final scores per place with method, priors and robust z."""
    weighted = cut_lineage(image_weights(images, as_of, half_life).select("poi_id", "age_days", "w_view", "weight", *dims))
    stats = place_stats(weighted, "poi_id", dims)
    scored = cut_lineage(shrink(places, stats, "poi_id", dims, "subtype", "planning_area", mix, strength))
    return robust_z_many(scored, {d: f"{d}_robust_z" for d in dims})

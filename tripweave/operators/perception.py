"""From image evidence to place scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.dates import age_days, decay_weight, iso_date, view_weight
from tripweave.functions.numeric import code_map
from tripweave.operators.lookup import with_group_stats
from tripweave.operators.pairwise import image_spread_scores
from tripweave.operators.ranking import keep_first, quota_top_n
from tripweave.session import cut_lineage


def _in_list(c: Column, names: Sequence[str]) -> Column:
    return c.isin(list(names)) if names else F.lit(False)


def fuse_features(mask: DataFrame, detections: DataFrame, key: str = "image_id",
                  sources: Mapping = K.FEATURE_SOURCES) -> DataFrame:
    """Feature shares per image from mask pixels and detections.

    ``s + (1 - s) * min(n / 5, 1) * w``: detections fill what the mask leaves. ``mask`` is
    (key, class, n_pixels), ``detections`` is (key, class, confidence).
    """
    n = F.col("n_pixels")
    shares = mask.groupBy(key).agg(
        *[
            (F.sum(F.when(_in_list(F.col("class"), segs), n).otherwise(0)) / F.sum(n)).alias(f"_s_{name}")
            for name, (segs, _, _) in sources.items()
        ]
    )
    seen = detections.filter(F.col("confidence") >= K.CONFIDENCE_MIN).groupBy(key).agg(
        *[F.count_if(_in_list(F.col("class"), dets)).alias(f"_d_{name}") for name, (_, dets, _) in sources.items()]
    )
    joined = shares.join(seen, key, "left")
    out = []
    for name, (_, _, weight) in sources.items():
        s = F.col(f"_s_{name}")
        d = F.least(F.coalesce(F.col(f"_d_{name}"), F.lit(0)) / K.DETECTION_CAP, F.lit(1.0))
        out.append(F.greatest(F.least(s + (1 - s) * d * weight, F.lit(1.0)), F.lit(0.0)).alias(name))
    return joined.select(key, *out)


def activity_diversity(detections: DataFrame, key: str = "image_id") -> DataFrame:
    """Normalised entropy of activity kinds among confident detections; none mapped gives 0."""
    from tripweave.operators.aggregates import category_entropy

    kinds = detections.filter(F.col("confidence") >= K.CONFIDENCE_MIN).withColumn(
        "_kind", code_map(F.col("class"), K.ACTIVITY_OF_CLASS)
    )
    scored = category_entropy(kinds.filter(F.col("_kind").isNotNull()), key, "_kind", K.ACTIVITY_KINDS, "activity_diversity")
    return detections.select(key).distinct().join(scored, key, "left").fillna(0.0, ["activity_diversity"])


def architectural_variety(hue: DataFrame, edges: DataFrame, key: str = "image_id") -> DataFrame:
    """0.6 x hue entropy + 0.4 x edge density over 0.3, in [0, 1].

    ``hue`` is (key, bin, n); ``edges`` is (key, edge_density).
    """
    from tripweave.operators.aggregates import category_entropy

    entropy = category_entropy(hue, key, "bin", K.HUE_BINS, "_entropy", weight="n")
    edge = F.greatest(F.least(F.col("edge_density") / 0.3, F.lit(1.0)), F.lit(0.0))
    variety = 0.6 * F.col("_entropy") + 0.4 * F.coalesce(edge, F.lit(0.0))
    return entropy.join(edges, key, "left").select(key, F.least(variety, F.lit(1.0)).alias("architectural_variety"))


def shading_coverage(hist: DataFrame, key: str = "image_id", level: str = "bin") -> DataFrame:
    """0.7 x share of brightness below 80 + 0.3 x share below 120, from a value histogram."""
    n = F.col("n")

    def below(limit: int) -> Column:
        return F.sum(F.when(F.col(level) < limit, n).otherwise(0)) / F.sum(n)

    return hist.groupBy(key).agg((0.7 * below(80) + 0.3 * below(120)).alias("shading_coverage"))


def image_weights(images: DataFrame, as_of, half_life: float = K.HALF_LIFE_DAYS) -> DataFrame:
    """Usable images with age, time weight, view weight and their product.

    Status must be ``ok``, the capture date valid and not after ``as_of``.
    """
    dated = images.filter(F.col("status") == "ok").withColumn("captured_date", iso_date(F.col("captured_at")))
    aged = dated.withColumn("age_days", age_days(F.col("captured_date"), as_of)).filter(F.col("age_days").isNotNull())
    return (
        aged.withColumn("w_time", decay_weight(F.col("age_days"), half_life))
        .withColumn("w_view", view_weight(F.col("is_panorama")))
        .withColumn("weight", F.col("w_time") * F.col("w_view"))
    )


def shrink(places: DataFrame, stats: DataFrame, key: str, dims: Sequence[str], category: str, area: str,
           mix: float | Column = K.PRIOR_MIX, strength: float | Column = K.PRIOR_STRENGTH, by: Sequence[str] = ()) -> DataFrame:
    """Reliability-weighted place scores.

    Priors mix the mean of the category's places and of the area's places; both fall back
    to the mean over all places. With no image the prior is the score, with an effective
    sample of 5 or more the place's own mean is, in between the two are blended.
    ``stats`` holds key, n_images, n_eff and ``{dim}_mean``. ``by`` names columns of ``places`` that set
    runs apart: each run has priors of its own, ``mix`` and ``strength`` may be columns, and
    ``stats`` is met on the ``by`` columns that it has.
    """
    placed = places.join(stats, [key, *[c for c in by if c in stats.columns]], "left").fillna({"n_images": 0, "n_eff": 0.0, category: "unknown", area: "unknown"})
    method = (
        F.when(F.col("n_images") == 0, "no_image")
        .when(F.col("n_eff") >= K.N_EFF_NORMAL, "normal").otherwise("shrinkage")
    )
    out = cut_lineage(placed.withColumn("aggregation_method", method))
    measured = out.filter(F.col("n_images") > 0)
    means = [f"{d}_mean" for d in dims]

    def with_means(df: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
        names = {c: f"_{tag}_of_{c}" for c in (*by, *cols)}
        sums = measured.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(*[F.avg(m).alias(f"_{tag}_{m}") for m in means])
        if not names:
            return df.crossJoin(F.broadcast(sums))
        return df.join(sums, [F.col(c) == F.col(n) for c, n in names.items()], "left")

    out = with_means(with_means(with_means(out, "cat", [category]), "area", [area]), "all", [])
    n_eff = F.col("n_eff")
    for d in dims:
        m = f"{d}_mean"
        prior = mix * F.coalesce(f"_cat_{m}", f"_all_{m}") + (1 - mix) * F.coalesce(f"_area_{m}", f"_all_{m}")
        own = F.coalesce(F.col(m), F.lit(0.0))
        blended = (n_eff * own + strength * F.col(f"{d}_prior")) / (n_eff + strength)
        out = out.withColumn(f"{d}_prior", prior).withColumn(
            d,
            F.when(F.col("aggregation_method") == "normal", own)
            .when(F.col("aggregation_method") == "shrinkage", blended)
            .otherwise(F.col(f"{d}_prior")),
        )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def prefilter_images(images: DataFrame, order: Sequence[str], first_year: int = K.FIRST_IMAGE_YEAR) -> DataFrame:
    """One row per image id (the first in ``order``), captured in ``first_year`` or later."""
    return keep_first(images, ["image_id"], order).filter(F.col("image_year") >= first_year)


def recency(df: DataFrame, key: str, year: str, out: str = "recency") -> DataFrame:
    """Year scaled to [0, 1] within the group; a single year gives 1."""
    df = with_group_stats(df, [key], _lo=F.min(year), _hi=F.max(year))
    return df.withColumn(
        out, F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(year) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    ).drop("_lo", "_hi")


def composite_score(df: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> DataFrame:
    """Weighted sum of the four image scores, missing ones as 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn("composite_score", total)


def image_capacity(images: DataFrame, key: str) -> DataFrame:
    """Add the size of each place (``n_images``), its subtype's minimum (``min_images``) and how many images it may
    keep (``capacity``). The subtype is the part of ``key`` before the first ``_``."""
    subtype = F.get(F.split(F.col(key), "_"), F.lit(0))
    sized = with_group_stats(images, [key], n_images=F.count(F.lit(1)))
    return sized.withColumn("min_images", code_map(subtype, K.MIN_IMAGES, K.MIN_IMAGES_DEFAULT)).withColumn(
        "capacity", F.least(code_map(subtype, K.CAPACITY, K.CAPACITY_DEFAULT).cast("bigint"), F.col("n_images"))
    )


def refine_images(images: DataFrame, key: str, x: str, y: str, heading: str, panorama_share: float = K.PANORAMA_SHARE,
                  weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> DataFrame:
    """Keep the best images of each place.

    Places below their subtype's minimum keep everything; the others keep their capacity,
    chosen by composite score with a cap on panoramas.
    """
    sized = cut_lineage(image_capacity(images, key).withColumnsRenamed({"min_images": "_min", "capacity": "_cap"}))
    small = sized.filter(F.col("n_images") < F.col("_min"))
    large = sized.filter(F.col("n_images") >= F.col("_min"))
    spread = image_spread_scores(large, key, x, y, heading).withColumnsRenamed(
        {key: "_k", x: "_x", y: "_y", heading: "_h"}
    ).drop("members")
    valid = F.when(F.col(heading) >= 0, F.col(heading).cast("double"))
    scored = large.join(
        spread,
        (F.col(key) == F.col("_k")) & (F.col(x).cast("double") == F.col("_x"))
        & (F.col(y).cast("double") == F.col("_y")) & valid.eqNullSafe(F.col("_h")),
        "left",
    ).drop("_k", "_x", "_y", "_h")
    scored = recency(scored, key, "image_year").withColumn("panorama", F.col("is_panorama").cast("double"))
    scored = composite_score(scored, weights)
    max_cap = max([*K.CAPACITY.values(), K.CAPACITY_DEFAULT])
    chosen = quota_top_n(scored, key, "composite_score", "image_id", F.col("is_panorama"), F.col("_cap"), panorama_share, max_cap)
    return chosen.drop("_min", "_cap").unionByName(small.drop("_min", "_cap"), allowMissingColumns=True)



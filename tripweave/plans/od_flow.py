"""Origin-destination flows from a logit share model with an outside option.

The OD table is the one that grows as origins x destinations. It is never gathered by
origin: the share's denominator is a partial aggregate per origin joined back, and
destination totals are a second partial aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.costs import car_cost, transit_cost
from tripweave.functions.numeric import clip, code_map, level_dummies, within_or_null
from tripweave.functions.text import parse_number
from tripweave.operators.aggregates import floored_average, quality_row, violations
from tripweave.operators.columns import require_columns, select_existing
from tripweave.operators.filters import is_clear_status, is_true_text, keep_non_negative
from tripweave.operators.linear import residualise, safe_corr, spearman
from tripweave.operators.lookup import inner_suffixed, with_group_stats
from tripweave.operators.profiling import count_flags
from tripweave.operators.quantiles import exact_quantiles
from tripweave.session import cut_lineage

HIGH_SHARE = 0.99
# --- fixed values: input columns ---
ORIGIN_COLUMNS = ["origin_id", "subzone_name", "planning_area", "pop_total", "avg_hh_size", "Mean_Monthly_Income",
                  "PCA_Car_Proxy_01", "cbd_flag", "central_area_flag"]
SCORES = ["vibrancy_robust_z", "pleasantness_robust_z", "walkability_robust_z", "safety_robust_z", "experiential_robust_z"]
FLAGS = ["has_supermarket", "has_cinema", "has_department_store", "has_foodcourt", "has_event_space"]


def clean_origins(raw: DataFrame) -> DataFrame:
    """Origins with a population and a car proxy in [0, 1]; zone flags default to 0."""
    df = select_existing(require_columns(raw, ["origin_id", "pop_total", "PCA_Car_Proxy_01"]), ORIGIN_COLUMNS)
    df = keep_non_negative(df.dropna(subset=["pop_total", "PCA_Car_Proxy_01"]), "pop_total")
    df = df.withColumn("PCA_Car_Proxy_01", clip(F.col("PCA_Car_Proxy_01").cast("double"), 0.0, 1.0))
    return _flags(df, ["cbd_flag", "central_area_flag"])


def _flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols if c in df.columns})


def clean_destinations(raw: DataFrame) -> DataFrame:
    """Destinations with a footprint; counts floored at 0, ratings outside 1-5 set NULL."""
    df = require_columns(raw, ["poi_id", "subtype", "footprint_area", "rating_count"]).filter(F.col("footprint_area") > 0)
    count = F.greatest(parse_number(F.col("rating_count").cast("string"), bad=0), F.lit(0.0)).cast("bigint")
    df = df.withColumn("rating_count", count).withColumn("eligible", (F.col("rating_count") > 0).cast("int"))
    if "popularity_proxy" in df.columns:
        df = df.withColumn("rating", within_or_null(parse_number(F.col("popularity_proxy").cast("string")), 1.0, 5.0))
    df = df.withColumn("subtype", F.lower(F.trim("subtype")))
    df = df.fillna(0.0, [c for c in SCORES if c in df.columns])
    return _flags(df, [*FLAGS, "cbd_flag", "central_area_flag"])


def clean_transit(raw: DataFrame) -> DataFrame:
    """Usable public-transport skims."""
    df = require_columns(raw, ["origin_id", "poi_id", "total_time_min", "transfers", "pt_fare_proxy", "accessible_flag"])
    df = df.filter(is_true_text(F.col("accessible_flag")))
    if "error_code" in df.columns:
        df = df.filter(is_clear_status(F.col("error_code")))
    return keep_non_negative(df, "total_time_min", "pt_fare_proxy", "transfers")


def clean_car(raw: DataFrame) -> DataFrame:
    """Usable car skims; the cost is summed from its parts when it is not stored."""
    df = raw
    if "total_cost_proxy" not in df.columns:
        parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("distance_cost", "erp_proxy", "park_fee_proxy") if c in df.columns]
        df = df.withColumn("total_cost_proxy", sum(parts, F.lit(0.0)))
    df = require_columns(df, ["origin_id", "poi_id", "travel_time_min", "accessible_flag"])
    return keep_non_negative(df.filter(is_true_text(F.col("accessible_flag"))), "travel_time_min", "total_cost_proxy")


def travel_costs(transit: DataFrame, car: DataFrame | None = None) -> DataFrame:
    """Generalised cost per pair, the car's alongside as a reference column."""
    od = transit.withColumn("gtc", transit_cost(F.col("total_time_min"), F.col("pt_fare_proxy"), F.col("transfers")))
    if car is None:
        return od
    side = car.select("origin_id", "poi_id", car_cost(F.col("travel_time_min"), F.col("total_cost_proxy")).alias("gtc_car"))
    return od.join(side, ["origin_id", "poi_id"], "left")


def size_classes(dest: DataFrame) -> DataFrame:
    """Size measure with its source, exact tertile class 0/1/2 and dummies."""
    has_gfa = F.col("gfa").isNotNull() & (F.col("gfa") > 0)
    df = dest.withColumn("scale_m2", F.when(has_gfa, F.col("gfa")).otherwise(F.col("footprint_area")).cast("double"))
    df = df.withColumn("scale_source", F.when(has_gfa, "gfa").otherwise("footprint"))
    return tertile(df, "scale_m2", "scale_cat")


def tertile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Left-closed tertile class 0/1/2 of a column, with D_sml, D_med and D_lrg."""
    cuts = exact_quantiles(df, [], value, {"_c1": 1 / 3, "_c2": 2 / 3})
    v = F.col(value)
    df = df.crossJoin(F.broadcast(cuts)).withColumn(out, F.when(v < F.col("_c1"), 0).when(v < F.col("_c2"), 1).otherwise(2))
    dummies = level_dummies(F.col(out))
    return df.withColumns({"D_sml": (F.col(out) == 0).cast("int"), **dummies}).drop("_c1", "_c2")


def category_codes(dest: DataFrame, codes: Mapping[str, int] = K.CATEGORY_CODES, default: int = K.CATEGORY_DEFAULT) -> DataFrame:
    """Category code of the subtype, unknown subtypes get the default, and one-hot columns."""
    df = dest.withColumn("cat_fe", code_map(F.col("subtype"), codes, default))
    listed = sorted(set(codes.values()) - {0})
    return df.withColumns({f"cat_fe_{k}": (F.col("cat_fe") == k).cast("int") for k in listed})


def trip_production(origins: DataFrame, population: str = "pop_total", core: str = "cbd_flag", car: str = "PCA_Car_Proxy_01") -> DataFrame:
    """Trips per origin: population x rate, and times a car multiplier."""
    rate = F.when(F.col(core) == 1, K.TRIP_RATE_CORE).otherwise(K.TRIP_RATE)
    return origins.withColumn("rate_o", rate).withColumn("T_o_base", F.col(population) * F.col("rate_o")).withColumn(
        "T_o", F.col("T_o_base") * F.exp(K.GAMMA_CAR * F.col(car))
    )


def car_residual(origins: DataFrame, od: DataFrame) -> DataFrame:
    """Car proxy with its dependence on mean travel cost taken out.

    Origins without a cost take the median of the others.
    """
    mean = od.groupBy("origin_id").agg(F.avg("gtc").alias("mean_gtc"))
    df = origins.join(mean, "origin_id", "left")
    middle = exact_quantiles(df, [], "mean_gtc", {"_mid": 0.5})
    df = df.crossJoin(F.broadcast(middle)).withColumn("mean_gtc", F.coalesce("mean_gtc", "_mid")).drop("_mid")
    return residualise(df, "PCA_Car_Proxy_01", "mean_gtc", "PCA_Car_resid")


def utilities(od: DataFrame, cost: str = "gtc") -> DataFrame:
    """Utility with and without the size terms."""
    plain = K.BETA_COST * F.col(cost)
    sized = plain + K.BETA_MEDIUM * F.col("D_med") + K.BETA_LARGE * F.col("D_lrg")
    return od.withColumn("V_od", sized).withColumn("V_plain", plain)


def shares(od: DataFrame, origin: str = "origin_id", outside: bool = True) -> DataFrame:
    """Choice share of each destination within its origin, both utilities in one pass.

    With the outside option the denominator gains 1: ``p_outside`` is its share and
    ``coverage`` the rest. The sums combine before their shuffle and come back as one row
    per origin, so OD rows do not move unless that side outgrows a broadcast.
    """
    extra = 1.0 if outside else 0.0
    df = od.withColumn("exp_V", F.exp("V_od")).withColumn("exp_V_plain", F.exp("V_plain"))
    df = with_group_stats(df, [origin], _sum=F.sum("exp_V"), _sum_plain=F.sum("exp_V_plain"))
    denom, denom_plain = F.col("_sum") + extra, F.col("_sum_plain") + extra
    return (
        df.withColumn("P_od", F.col("exp_V") / denom).withColumn("P_plain", F.col("exp_V_plain") / denom_plain)
        .withColumn("p_outside", extra / denom).withColumn("p_outside_plain", extra / denom_plain)
        .withColumn("coverage", F.col("_sum") / denom).drop("_sum", "_sum_plain")
    )


def flows(od: DataFrame, production: str = "T_o_base") -> DataFrame:
    """Trips times share."""
    return od.withColumn("flow_base", F.col(production) * F.col("P_od")).withColumn("flow_plain", F.col(production) * F.col("P_plain"))


def destination_totals(od: DataFrame, dest: str = "poi_id") -> DataFrame:
    """Predicted visits per destination, and coverage weighted by flow."""
    totals = od.groupBy(dest).agg(F.sum("flow_base").alias("mu_base"), F.sum("flow_plain").alias("mu_plain_base"))
    return totals.join(floored_average(od, [dest], "coverage", "flow_base", "mean_coverage"), dest)


def scale_factor(totals: DataFrame, observed: str) -> DataFrame:
    """One row: observed over predicted."""
    return totals.agg((F.sum(observed) / F.sum("mu_base")).alias("scale_factor"))


def calibration(dest: DataFrame, od: DataFrame, observed: str = "rating_count") -> DataFrame:
    """One row per destination with scaled predictions, which sum to the observed total.

    A destination no flow reaches counts 0 and takes the mean coverage over origins.
    """
    cover = od.groupBy("origin_id").agg(F.first("coverage").alias("_c")).agg(F.avg("_c").alias("_cover"))
    df = dest.join(destination_totals(od), "poi_id", "left").fillna(0.0, ["mu_base", "mu_plain_base"])
    df = df.crossJoin(F.broadcast(cover)).withColumn("mean_coverage", F.coalesce("mean_coverage", "_cover")).drop("_cover")
    df = df.crossJoin(F.broadcast(scale_factor(df, observed)))
    return df.withColumn("mu_j", F.col("mu_base") * F.col("scale_factor")).withColumn(
        "mu_j_no_scale", F.col("mu_plain_base") * F.col("scale_factor")
    )


def long_table(od: DataFrame, dest: DataFrame, origins: DataFrame) -> DataFrame:
    """Long OD calibration table with destination and origin attributes (``_d`` / ``_o``)."""
    d = select_existing(dest, ["poi_id", "subtype", "cat_fe", *SCORES, "cbd_flag", "central_area_flag"])
    o = select_existing(origins, ["origin_id", "subzone_name", "pop_total", "rate_o", "cbd_flag", "central_area_flag", "mean_gtc", "PCA_Car_Proxy_01"])
    slim = od.drop(*[c for c in [*d.columns, *o.columns] if c in od.columns and c not in ("poi_id", "origin_id")])
    with_d = slim.join(d, "poi_id")
    return inner_suffixed(with_d, o, ["origin_id"], ("_d", "_o"))


def invariants(od: DataFrame, dest: DataFrame) -> DataFrame:
    """Rules the result must meet, with the number of violations."""
    per_origin = od.groupBy("origin_id").agg(
        F.sum("P_od").alias("p"), F.sum("P_plain").alias("pp"), F.first("p_outside").alias("o"), F.first("p_outside_plain").alias("op")
    )
    a = violations(per_origin, {
        "shares plus outside = 1": F.abs(F.col("p") + F.col("o") - 1) > 1e-6,
        "plain shares plus outside = 1": F.abs(F.col("pp") + F.col("op") - 1) > 1e-6,
    })
    b = violations(dest, {
        "negative prediction": F.col("mu_j_no_scale") < 0,
        "scale factor not finite": F.col("scale_factor").isNull() | F.isnan("scale_factor"),
    })
    return a.unionByName(b)


def quality_log(dest: DataFrame, table: DataFrame, od: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Check rows on all cleaned destinations (``dest``, with ``eligible``): counts, high outliers,
    ratings, coverage of skims; on ``od``: coverage fraction; on the calibration ``table``: prior
    validity; on ``origins``: car proxy against cost. Checks without their columns are left out.
    """
    n = F.count(F.lit(1))
    c = F.col("rating_count")
    zero, sparse = F.count_if(c == 0), F.count_if((c > 0) & (c <= K.SPARSE_COUNT))
    rows = [
        quality_row(dest, "rating_count_zero", zero, F.bround(zero / n, 4), F.when(zero < 100, "OK").otherwise("WARN"), "no reviews"),
        quality_row(dest, "rating_count_sparse", sparse, F.bround(sparse / n, 4), F.when(sparse < 50, "OK").otherwise("WARN"), "few reviews"),
    ]
    high = exact_quantiles(dest, [], "rating_count", {"_high": HIGH_SHARE})
    outliers = F.count_if(c > F.col("_high"))
    rows.append(quality_row(dest.crossJoin(F.broadcast(high)), "rating_count_high_outlier", outliers, F.bround(outliers / n, 4), F.lit("OK"), "top share; run sensitivity"))
    if "rating" in dest.columns:
        rated = F.count("rating")
        rows.append(quality_row(dest, "rating_star_descriptive", rated, F.bround(rated / n, 4), F.lit("INFO"), "rated places"))
        stars = spearman(dest.filter("rating_count > 0"), "rating_count", "rating").filter(F.col("n") >= 10)
        against = quality_row(stars, "lambda_exclusion_check", F.bround(F.max("rho"), 4), None, F.when(F.abs(F.max("rho")) < 0.15, "OK").otherwise("WARN"), "rank correlation of count and rating")
        rows += [against.filter("value is not null"), quality_row(dest, "rating_subtype_ranking", F.lit(None), None, F.lit("INFO"), "see rating_by_subtype")]
    eligible = dest.filter("eligible = 1").select("poi_id").distinct()
    reached = od.select("poi_id").distinct().withColumn("_hit", F.lit(1))
    seen = eligible.join(reached, "poi_id", "left")
    share = F.count("_hit") / n
    rows.append(quality_row(seen, "eligible_pois_pt_coverage", F.count("_hit"), F.bround(share, 4), F.when(share > 0.85, "OK").otherwise("WARN"), "eligible with skims"))
    cover = od.groupBy("origin_id").agg(F.first("coverage").alias("c"))
    rows.append(quality_row(cover, "outside_option_coverage", F.bround(F.avg("c"), 4), None, F.when(F.avg("c") > 0.30, "OK").otherwise("WARN"), "mean coverage"))
    if origins is not None:
        r = safe_corr("PCA_Car_Proxy_01", "mean_gtc")
        rows.append(quality_row(origins, "pca_car_gtc_collinearity", F.bround(r, 4), None, F.when(F.abs(r) < 0.40, "OK").otherwise("WARN"), "before the residual is taken"))
    rho = spearman(table, "mu_j", "rating_count")
    rows.append(quality_row(rho, "prior_validity_spearman_rho", F.bround(F.max("rho"), 4), None, F.when(F.max("rho") > 0.2, "OK").otherwise("WARN"), "rank correlation with counts"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def rating_by_subtype(dest: DataFrame) -> DataFrame:
    """Median star rating per subtype, for the face validity of the ratings."""
    return exact_quantiles(dest, ["subtype"], "rating", {"median_rating": 0.5})


def validity_by_category(table: DataFrame, least: int = 5) -> DataFrame:
    """Rank correlation of prediction and count per category code with ``least`` places or more."""
    return spearman(table, "mu_j", "rating_count", ["cat_fe"]).filter(F.col("n") >= least)


def with_count_flags(dest: DataFrame, count: str = "rating_count") -> DataFrame:
    """Quality flag of the count column with the exact 99th percentile as the high mark."""
    high = exact_quantiles(dest, [], count, {"_high": 0.99})
    return count_flags(dest.crossJoin(F.broadcast(high)), count, f"{count}_flag", K.SPARSE_COUNT, "_high").drop("_high")


def run(origins_raw: DataFrame, dest_raw: DataFrame, transit_raw: DataFrame, car_raw: DataFrame | None = None,
        outside: bool = True) -> dict[str, DataFrame]:
    """The whole plan: tables ``od``, ``dest``, ``long``, ``quality`` and ``invariants``.

    The cleaned skims, the coded destinations and the OD flows are each stored once, because
    several results read them.
    """
    origins = trip_production(clean_origins(origins_raw))
    cleaned = cut_lineage(clean_destinations(dest_raw))
    dest = cut_lineage(category_codes(size_classes(with_count_flags(cleaned))))
    od = cut_lineage(travel_costs(clean_transit(transit_raw), clean_car(car_raw) if car_raw is not None else None))
    reached = od.select("poi_id").distinct()
    eligible = dest.filter("eligible = 1").join(reached, "poi_id", "left_semi")
    origins = cut_lineage(car_residual(origins, od))
    od = od.join(eligible.select("poi_id", "D_med", "D_lrg"), "poi_id")
    od = od.join(origins.select("origin_id", "T_o_base", "T_o"), "origin_id")
    od = cut_lineage(flows(shares(utilities(od), outside=outside)))
    table = cut_lineage(calibration(eligible, od))
    factor: Column = F.col("scale_factor")
    od_scaled = od.crossJoin(F.broadcast(table.select("scale_factor").limit(1))).withColumn("flow_od", F.col("flow_base") * factor)
    return {
        "od": od_scaled, "dest": table, "long": long_table(od_scaled, table, origins),
        "quality": quality_log(dest, table, od, origins), "invariants": invariants(od, table),
    }

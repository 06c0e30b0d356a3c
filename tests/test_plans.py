"""The flow plan and the repeatable sample against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.operators.ranking import hashed_sample
from tripweave.plans import od_flow


def test_flow_plan_matches_numpy(spark):
    rng = np.random.default_rng(21)
    n_o, n_d = 6, 12
    pop, car = rng.integers(100, 900, n_o), rng.uniform(0, 1, n_o)
    core = (np.arange(n_o) % 3 == 0).astype(int)
    size, count = rng.uniform(100, 9000, n_d), rng.integers(1, 400, n_d)
    count[3] = 0  # not eligible
    minutes, fare, change = rng.uniform(10, 90, (n_o, n_d)), rng.uniform(1, 3, (n_o, n_d)), rng.integers(0, 3, (n_o, n_d))
    origins = spark.createDataFrame(
        [(f"o{i}", int(pop[i]), float(car[i]), int(core[i]), None) for i in range(n_o)] + [("bad", None, 0.5, 0, 0), ("worse", 5, None, 0, 0)],
        "origin_id string, pop_total int, PCA_Car_Proxy_01 double, cbd_flag int, central_area_flag int",
    )
    subtype = [" Mall", "park", "Museum", "unheard of"]
    dests = spark.createDataFrame(
        [(f"d{j}", subtype[j % 4], float(size[j]), None if j % 2 else 0.0, str(count[j]), 4.5 if j else 7.0) for j in range(n_d)] + [("flat", "park", 0.0, None, "9", 1.0)],
        "poi_id string, subtype string, footprint_area double, gfa double, rating_count string, popularity_proxy double",
    )
    skims = spark.createDataFrame(
        [(f"o{i}", f"d{j}", float(minutes[i, j]), int(change[i, j]), float(fare[i, j]), "True", "OK") for i in range(n_o) for j in range(n_d)]
        + [("o1", "d1", -5.0, 0, 1.0, "1", "OK"), ("o1", "d2", 5.0, 0, 1.0, "0", "OK"), ("o1", "d4", 5.0, 0, 1.0, "1", "HTTP_404")],
        "origin_id string, poi_id string, total_time_min double, transfers int, pt_fare_proxy double, accessible_flag string, error_code string",
    )
    out = od_flow.run(origins, dests, skims)
    got = {r["poi_id"]: r for r in out["dest"].collect()}

    low, high = np.percentile(size, [100 / 3, 200 / 3])
    kind = np.where(size < low, 0, np.where(size < high, 1, 2))
    keep = [j for j in range(n_d) if count[j] > 0]
    gtc = minutes + fare / K.VALUE_OF_TIME + change * K.TRANSFER_PENALTY_MIN
    v = K.BETA_COST * gtc + np.array([0, K.BETA_MEDIUM, K.BETA_LARGE])[kind]
    e, ep = np.exp(v[:, keep]), np.exp(K.BETA_COST * gtc[:, keep])
    trips = pop * np.where(core == 1, K.TRIP_RATE_CORE, K.TRIP_RATE)
    mu = (trips[:, None] * e / (e.sum(axis=1, keepdims=True) + 1)).sum(axis=0)
    plain = (trips[:, None] * ep / (ep.sum(axis=1, keepdims=True) + 1)).sum(axis=0)
    factor = count[keep].sum() / mu.sum()
    assert set(got) == {f"d{j}" for j in keep}
    for at, j in enumerate(keep):
        r = got[f"d{j}"]
        assert (r["mu_j"], r["mu_j_no_scale"], r["scale_cat"]) == (pytest.approx(mu[at] * factor), pytest.approx(plain[at] * factor), kind[j])
        assert r["cat_fe"] == [0, 5, 3, 5][j % 4]
    assert got["d0"]["rating"] is None and got["d1"]["rating"] == 4.5
    assert sum(r["mu_j"] for r in got.values()) == pytest.approx(count[keep].sum())
    assert all(r["count"] == 0 for r in out["invariants"].collect())
    assert out["long"].count() == n_o * len(keep)
    assert {r["check"] for r in out["quality"].collect()} == {
        "rating_count_zero", "rating_count_sparse", "rating_count_high_outlier", "eligible_pois_pt_coverage", "outside_option_coverage",
        "pca_car_gtc_collinearity", "prior_validity_spearman_rho", "rating_star_descriptive", "rating_subtype_ranking",
    }


def test_sample_repeats_and_is_bounded(spark):
    df = spark.range(1000)
    first = [r["id"] for r in hashed_sample(df, "id", 100).collect()]
    again = [r["id"] for r in hashed_sample(df.repartition(7), "id", 100).collect()]
    assert first == again and len(set(first)) == 100
    assert hashed_sample(df, "id", 5000).count() == 1000
    assert [r["id"] for r in hashed_sample(df, "id", 100, seed=1).collect()] != first


def test_share_without_outside_option(spark):
    od = spark.createDataFrame([("a", "x", 10.0, 0, 0), ("a", "y", 20.0, 1, 0)], "origin_id string, poi_id string, gtc double, D_med int, D_lrg int")
    out = od_flow.shares(od_flow.utilities(od), outside=False).agg(F.sum("P_od").alias("p"), F.max("p_outside").alias("o"), F.min("coverage").alias("c")).first()
    assert (out["p"], out["o"], out["c"]) == (pytest.approx(1.0), 0.0, 1.0)

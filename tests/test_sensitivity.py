"""The grid of place scores against one scoring a grid row."""

import pytest
from pyspark.sql import functions as F

from tripweave.operators.posterior import parameter_grid
from tripweave.plans.places import score_places
from tripweave.plans.sensitivity import judge, score_effects, score_grid


@pytest.fixture(scope="module")
def tables(spark):
    images = [
        (f"p{i % 11}", "ok" if i % 7 else "failed", f"202{i % 4}-0{1 + i % 9}-11T00:00:00" if i % 13 else None,
         "TRUE" if i % 3 == 0 else "false", None if i % 17 == 0 else float(i * 37 % 101), float(i * 53 % 89))
        for i in range(160)
    ] + [("p20", "ok", "2023-05-05T00:00:00", "false", None, 3.0)]
    places = [(f"p{i}", None if i == 4 else "park" if i % 2 else "mall", None if i == 5 else f"area{i % 3}", float(i * i % 23)) for i in range(25)]
    return (
        spark.createDataFrame(images, "poi_id string, status string, captured_at string, is_panorama string, v double, s double"),
        spark.createDataFrame(places, "poi_id string, subtype string, planning_area string, outcome double"),
    )


def test_grid_equals_one_scoring_a_row(spark, tables):
    images, places = tables
    got = {(r.tag, r.poi_id): r for r in score_grid(images, places, "2024-06-01", ["v", "s"]).collect()}
    runs = parameter_grid(spark).collect()
    assert len(runs) == 7 and len(got) == 7 * 25
    for run in (runs[0], runs[1], runs[4], runs[6]):
        for r in score_places(images, places, "2024-06-01", ["v", "s"], run["half_life"], run["alpha"], run["kappa"]).collect():
            g = got[run["tag"], r.poi_id]
            assert (g.n_images, g.aggregation_method) == (r.n_images, r.aggregation_method)
            for c in ("n_eff", "v", "s", "v_prior", "s_prior"):
                assert g[c] == pytest.approx(r[c], rel=1e-9, abs=1e-12)


def test_effects_and_empty_tables(spark, tables):
    import numpy as np

    images, places = tables
    scores = score_grid(images, places, "2024-06-01", ["v", "s"])
    runs = score_effects(scores.withColumn("flat", F.lit(1.0)), "outcome", ["v", "flat"])
    got = {(r.tag, r.parameter): r for r in runs.collect()}
    tag = parameter_grid(spark).filter("varied_param = 'baseline'").first().tag
    pairs = [(r.v, r.outcome) for r in scores.filter(F.col("tag") == tag).collect()]
    x, y = np.array(pairs).T
    fit, cov = np.polyfit(x, y, 1, cov=True)
    assert got[tag, "v"].mean == pytest.approx(fit[0]) and got[tag, "v"].sd == pytest.approx(cov[0, 0] ** 0.5)
    assert got[tag, "flat"].mean is None and got[tag, "flat"].significant is None
    assert {r.parameter for r in judge(runs).collect()} == {"v", "flat"}
    assert score_grid(images, places.limit(0), "2024-06-01", ["v"]).count() == 0
    no_images = score_grid(images.limit(0), places, "2024-06-01", ["v"])
    assert {(r.aggregation_method, r.v) for r in no_images.collect()} == {("no_image", None)}

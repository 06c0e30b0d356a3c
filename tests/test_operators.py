"""Operators against brute force and hand-worked tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions import geo
from tripweave.operators import allocation, columns, dedup, lookup, pairwise, perception, quantiles, ranking, spatial
from tripweave.operators.aggregates import weighted_moments


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_require_and_select(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert columns.select_existing(df, ["b", "z", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        columns.require_columns(df, ["a", "z"])


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(5)
    # one group holds most rows, with many ties
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 4)}", rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 2)) * 1.0])) for _ in range(3000)]
    data += [("g0", None), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.03, "b": 0.5, "c": 0.75}, ranges=8).collect()}
    for k in {d[0] for d in data} - {None}:
        values = [v for g, v in data if g == k and v is not None]
        assert got[k] == pytest.approx(tuple(np.percentile(values, [3, 50, 75])))
    assert None not in got


def test_average_ranks_match_pandas(spark):
    rng = random.Random(6)
    data = [(i, f"g{i % 3}", float(rng.randint(0, 20)) if i % 10 else None) for i in range(500)]
    got = {r["i"]: r["r"] for r in quantiles.average_ranks(spark.createDataFrame(data, "i int, g string, v double"), "v", "r", ["g"]).collect()}
    frame = pd.DataFrame(data, columns=["i", "g", "v"])
    want = frame.groupby("g")["v"].rank().tolist()
    assert all((got[i] is None and math.isnan(w)) or got[i] == w for i, w in enumerate(want))


@pytest.mark.parametrize("counts,want", [
    ([0, 10, 20, 10], (15.0, False)),  # inside an inner class
    ([0, 20, 20, 0], (10.0, False)),  # exactly at a boundary
    ([1, 1, 1, 30], (None, True)),  # in the open class
    ([0, 0, 0, 0], (None, False)),  # no members
])
def test_grouped_median(spark, counts, want):
    data = [("z", i, float(i * 10 - 10), 10.0, float(n), i == 3) for i, n in enumerate(counts)]
    df = spark.createDataFrame(data, "k string, c int, lower double, width double, n double, is_open boolean")
    r = allocation.grouped_median(df, ["k"], "c", "lower", "width", "n", "is_open").first()
    assert (r["median"], r["median_open"]) == want


def test_allocation_sums_back(spark):
    data = [("a", 3.0, 100.0), ("a", 1.0, 100.0), ("b", 0.0, 50.0), ("b", 0.0, 50.0)]
    out = allocation.allocate(spark.createDataFrame(data, "g string, p double, v double"), "g", "p", ["v"])
    assert sorted(r["v"] for r in out.collect()) == [0.0, 0.0, 25.0, 75.0]


def greedy(items, n, share):
    """The rule as a loop: best first, the limited class capped, then back-filled."""
    order = sorted(items, key=lambda r: (-r[1], r[0]))
    chosen, used = [], 0
    for r in order:
        if len(chosen) >= n:
            break
        if r[2]:
            if used < int(n * share):
                chosen.append(r[0])
                used += 1
        else:
            chosen.append(r[0])
    for r in order:
        if len(chosen) < n and r[0] not in chosen:
            chosen.append(r[0])
    return set(chosen)


def test_quota_equals_greedy(spark):
    rng = random.Random(7)
    groups = {f"g{k}": [(i, float(rng.randint(0, 9)), rng.random() < rng.choice([0.1, 0.5, 0.95])) for i in range(rng.randint(1, 25))] for k in range(60)}
    data = [(g, *r) for g, rs in groups.items() for r in rs]
    df = spark.createDataFrame(data, "g string, i int, s double, lim boolean")
    out = ranking.quota_top_n(df, "g", "s", "i", F.col("lim"), 10, 0.3, 10)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], set()).add(r["i"])
    assert got == {g: greedy(rs, 10, 0.3) for g, rs in groups.items()}


def test_running_id_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.concat(F.lit("x"), F.pmod(F.col("id") * 7919, F.lit(1000))))
    ids = {r["k"]: r["n"] for r in ranking.running_id(df, ["k"], "n").collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(1, 1001))


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(rows(ranking.keep_first(df, ["k"], ["o"])), key=repr) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(rows(ranking.keep_first(df, ["k"], ["o"], last=True))) == [("a", 2, "y"), ("b", 5, "z")]


def test_last_state_decides(spark):
    log = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("b", 1, "ok"), ("b", 2, "error")], "k string, o int, s string")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(rows(lookup.still_to_do(work, log, "k", "o", "s"))) == [("b",), ("c",)]


def test_probe_all_slices_give_the_same_pairs(spark):
    left, probes = spark.range(20).withColumnRenamed("id", "a"), spark.range(50).withColumnRenamed("id", "b")
    assert sorted(rows(lookup.probe_all(left, probes))) == sorted(rows(lookup.probe_all(left, probes, slices=3))) == sorted(rows(left.crossJoin(probes)))


def test_weighted_moments_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("a", 1.0, 4.0)], "k string, w double, x double")
    r = weighted_moments(df, ["k"], "w", ["x"]).first()
    assert (r["x_mean"], r["x_var"], r["n_eff"]) == (3.0, 1.0, pytest.approx(25 / 11))


def brute_spread(points):
    xy = np.array([p[:2] for p in points])
    h = np.array([np.nan if p[2] is None else p[2] for p in points], dtype=float)
    n = len(points)
    s = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    a = np.abs(h[:, None] - h[None, :])
    a = np.nan_to_num(np.minimum(a, 360 - a))
    if n == 1:
        return np.ones(1), np.ones(1)
    sd = s / s.max() if s.max() > 0 else s
    if np.isnan(h).all():
        d = sd.sum(axis=1) / (n - 1)
        d = d / d.max() if d.max() > 0 else np.ones(n)
    else:
        ad = a / a.max() if a.max() > 0 else a
        d = (0.6 * sd + 0.4 * ad).sum(axis=1) / (n - 1)
        d = d / d.max() if d.max() > 0 else d
    if n < 3:
        return d, np.ones(n)
    cov = np.cov(xy.T) * n ** (-1 / 3)
    det = np.linalg.det(cov)
    if cov[0, 0] == 0 or det <= 1e-12 * cov[0, 0] * cov[1, 1]:
        m = s.sum(axis=1) / (n - 1)
        return d, m / m.max() if m.max() > 0 else np.ones(n)
    inv = np.linalg.inv(cov)
    diff = xy[:, None] - xy[None, :]
    dens = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", diff, inv, diff)).sum(axis=1) / n / (2 * np.pi * np.sqrt(det))
    b = 1 / (1 + np.log(dens + 1))
    return d, (b - b.min()) / (b.max() - b.min()) if b.max() > b.min() else np.ones(n)


def test_spread_scores_match_brute_force(spark):
    rng = random.Random(11)
    groups = {
        "one": [(1.0, 2.0, 10.0)], "two": [(1.0, 2.0, 10.0), (3.0, 4.0, None)], "line": [(float(i), 2.0 * i, 5.0 * i) for i in range(6)],
        "same": [(1.0, 1.0, None)] * 4, "blind": [(rng.random(), rng.random(), None) for _ in range(9)],
        "many": [(rng.random(), rng.random(), rng.choice([None, rng.random() * 360])) for _ in range(60)] + [(0.5, 0.5, 90.0)] * 7,
    }
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "g string, x double, y double, h double")
    for block in (256, 10):
        old, pairwise.BLOCK = pairwise.BLOCK, block
        scores = {(r["g"], r["x"], r["y"], r["h"]): (r["diversity"], r["balance"]) for r in pairwise.image_spread_scores(df, "g", "x", "y", "h").collect()}
        pairwise.BLOCK = old
        for g, ps in groups.items():
            d, b = brute_spread(ps)
            for p, dv, bv in zip(ps, d, b):
                assert scores[(g, *p)] == pytest.approx((dv, bv), abs=1e-7), (g, p)


def test_pair_sums_of_odd_coordinates(spark):
    """Points are told apart by their coordinates; unknown ones keep their row and give no distance."""
    nan = float("nan")
    df = spark.createDataFrame([("g", 0.0, 0.0, 10.0), ("g", -0.0, 0.0, 10.0), ("g", 3.0, 4.0, nan), ("h", None, 1.0, 5.0), ("h", nan, 1.0, 5.0), (None, 1.0, 1.0, 1.0)], "g string, x double, y double, h double")
    out = {(r.g, r.x, r.y, r.h): (r.members, r.spatial) for r in pairwise.group_pair_sums(df, "g", "x", "y", "h").collect()}
    assert {k: v for k, v in out.items() if k[0] == "g"} == {("g", 0.0, 0.0, 10.0): (2, 5.0), ("g", 3.0, 4.0, None): (1, 10.0)}
    assert {(k, v[0]) for k, v in out.items() if k[0] == "h"} == {(("h", None, 1.0, 5.0), 2)}


def test_refine_keeps_small_groups_and_fills_capacity(spark):
    rng = random.Random(2)
    data = [(f"5_MU_{k}", f"{k}-{i}", rng.random(), rng.random(), rng.random() * 360, rng.random() < 0.6, 2019 + i % 5) for k, n in ((1, 9), (2, 80)) for i in range(n)]
    df = spark.createDataFrame(data, "POI_ID string, image_id string, x double, y double, h double, is_panorama boolean, image_year int")
    out = perception.refine_images(df, "POI_ID", "x", "y", "h")
    kept = {r["POI_ID"]: (r["n"], r["p"]) for r in out.groupBy("POI_ID").agg(F.count("*").alias("n"), F.count_if("is_panorama").alias("p")).collect()}
    assert kept["5_MU_1"][0] == 9
    assert kept["5_MU_2"] == (30, 9)


def brute_components(points, eps):
    n, label = len(points), list(range(len(points)))
    for i in range(n):
        for j in range(i):
            if math.hypot(points[i][0] - points[j][0], points[i][1] - points[j][1]) <= eps:
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def partition(keys):
    out = {}
    for i, k in enumerate(keys):
        out.setdefault(k, set()).add(i)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("fine,block", [(8, 512), (1, 3)])
def test_clusters_match_brute_force(spark, fine, block):
    rng = random.Random(13)
    pts = [(rng.random() * 120, rng.random() * 120) for _ in range(150)]
    pts += [(200.0 + i * 9.9, 50.0) for i in range(40)] + [(0.0, 300.0), (10.0, 300.0), (20.01, 300.0)] + [(400.0, 400.0)] * 5
    df = spark.createDataFrame([(i, "g", *p, 10) for i, p in enumerate(pts)], "i int, g string, x double, y double, eps int")
    old = dedup.FINE, dedup.BLOCK
    dedup.FINE, dedup.BLOCK = fine, block
    got = {r["i"]: r["cluster"] for r in dedup.cluster_points(df, ["g"], "x", "y", "eps").collect()}
    dedup.FINE, dedup.BLOCK = old
    assert partition([got[i] for i in range(len(pts))]) == partition(brute_components(pts, 10))


def test_clusters_keep_groups_apart(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 5), (2, "b", 1.0, 0.0, 5), (3, "a", 3.0, 0.0, 5)], "i int, g string, x double, y double, eps int")
    got = {r["i"]: r["cluster"] for r in dedup.cluster_points(df, ["g"], "x", "y", "eps").collect()}
    assert got[1] == got[3] != got[2]


def test_long_chain_component(spark):
    edges = spark.range(2000).select(F.format_string("%05d", "id").alias("a"), F.format_string("%05d", F.col("id") + 1).alias("b"))
    out = dedup.components(edges)
    assert out.count() == 2001 and rows(out.select("component").distinct()) == [("00000",)]


def box(x0, y0, x1, y1):
    return [[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


RINGS = "array<array<struct<x: double, y: double>>>"


def test_union_area(spark):
    data = [("a", box(0, 0, 10, 10)), ("a", box(5, 5, 15, 15)), ("b", box(0.25, 0.25, 1.5, 1.5)), ("c", box(0, 0, 2, 2)), ("c", box(4, 0, 6, 2))]
    out = dict(rows(spatial.union_area(spark.createDataFrame(data, f"k string, rings {RINGS}"), ["k"], "rings", "area")))
    assert out == {"a": pytest.approx(175.0), "b": pytest.approx(1.5625), "c": pytest.approx(8.0)}


def test_point_in_polygon_takes_first_and_reports_unmatched(spark):
    zones = spark.createDataFrame([(2, "big", box(-1000, -1000, 1000, 1000)), (1, "small", box(0, 0, 10, 10))], f"o int, name string, rings {RINGS}")
    pts = spark.createDataFrame([("p", 5.0, 5.0), ("q", 50.0, 5.0), ("r", 5000.0, 0.0), ("edge", 0.0, 5.0)], "id string, x double, y double")
    out = dict(rows(spatial.point_in_polygon(pts, "id", "x", "y", zones, "rings", "o", ["name"]).select("id", "name")))
    assert out == {"p": "small", "q": "big", "r": None, "edge": "big"}


def test_cascade_stages(spark):
    places = spark.createDataFrame(
        [("in", "Alpha Mall", "mall", 5.0, 5.0), ("two", "Beta Mall", "mall", 105.0, 5.0), ("name", "Gamma Plaza", "museum", 225.0, 5.0),
         ("largest", "Nothing Alike", "museum", 325.0, 5.0), ("none", "Far", "museum", 9000.0, 9000.0), ("rule", "Alpha Mall", "mall", 405.0, 5.0)],
        "poi_id string, name string, subtype string, x double, y double",
    )
    features = spark.createDataFrame(
        [(1, "x", "mall", "", box(0, 0, 10, 10)), (2, "x", "mall", "", box(100, 0, 110, 10)), (3, "x", "", "retail", box(100, 0, 110, 6)),
         (4, "Gamma Plaza West", "", "", box(230, 0, 240, 10)), (5, "other", "", "", box(200, 0, 220, 90)),
         (6, "zzz", "", "", box(330, 0, 340, 10)), (7, "qqq", "", "", box(300, 0, 320, 10)), (8, "Alpha Mall", "", "", box(400, 0, 410, 10))],
        f"osm_id int, feature_name string, shop string, building string, rings {RINGS}",
    )
    out = {r["poi_id"]: (r["match_type"], r["footprint_area"]) for r in spatial.match_footprints(places, features).collect()}
    assert out == {
        "in": ("pip_single", 100.0), "two": ("pip_union", pytest.approx(100.0)), "name": ("name_match_single", 100.0),
        "largest": ("largest_polygon", 200.0), "none": ("no_match", 0.0), "rule": ("no_match", 0.0),
    }


def test_points_along(spark):
    line = [(0.0, 0.0), (30.0, 0.0), (30.0, 10.0)]
    df = spark.createDataFrame([("a", line), ("short", [(0.0, 0.0), (4.0, 0.0)]), ("exact", [(0.0, 0.0), (24.0, 0.0)])], "k string, line array<struct<x: double, y: double>>")
    out = sorted(rows(spatial.points_along(df, "k", "line", 12.0)))
    assert out == [("a", 0, 0.0, 0.0), ("a", 1, 12.0, 0.0), ("a", 2, 24.0, 0.0), ("a", 3, 30.0, 6.0), ("exact", 0, 0.0, 0.0), ("exact", 1, 12.0, 0.0)]


def test_shrinkage_methods(spark):
    places = spark.createDataFrame([("a", "c1", "z1"), ("b", "c1", None), ("n", "c9", "z9")], "poi_id string, subtype string, planning_area string")
    stats = spark.createDataFrame([("a", 9, 6.0, 10.0), ("b", 2, 2.0, 4.0)], "poi_id string, n_images bigint, n_eff double, v_mean double")
    out = {r["poi_id"]: r for r in perception.shrink(places, stats, "poi_id", ["v"], "subtype", "planning_area").collect()}
    assert (out["a"]["aggregation_method"], out["a"]["v"]) == ("normal", 10.0)
    prior_b = 0.6 * 7 + 0.4 * 4
    assert out["b"]["v"] == pytest.approx((2 * 4 + 4 * prior_b) / 6)
    assert (out["n"]["aggregation_method"], out["n"]["v"]) == ("no_image", pytest.approx(7.0))


def test_fusion(spark):
    mask = spark.createDataFrame([("i", "person", 20), ("i", "sky", 80)], "image_id string, class string, n_pixels bigint")
    found = spark.createDataFrame([("i", "person", 0.9)] * 7 + [("i", "person", 0.1), ("i", "zebra", 0.9)], "image_id string, class string, confidence double")
    r = perception.fuse_features(mask, found).first()
    assert r["pedestrian_presence"] == pytest.approx(0.2 + 0.8 * 0.5) and r["sky_visibility"] == 0.8 and r["greenery"] == 0.0


def test_grid_box(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.6, 0.1), (1.5, 0.2)], "x double, y double")
    assert spatial.square_grid(df, "x", "y", 1.0).select(F.sum(geo.polygon_area(F.col("rings")))).first()[0] == 2.0
    assert K.RING_POINTS == 8


def test_quantiles_of_infinite_values(spark):
    from pyspark.sql import functions as F
    from tripweave.operators.quantiles import exact_quantiles
    from tripweave.session import cut_lineage

    df = cut_lineage(spark.range(5000).selectExpr(
        "id % 7 as k", "case when id % 50 = 0 then double('infinity') when id % 51 = 0 then double('-infinity') else cast(id * 37 % 1001 as double) end as v"))
    probs = {"a": 0.1, "b": 0.5, "c": 0.995}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()])
    for ranges in (None, 3, 300):
        assert sorted(exact_quantiles(df, ["k"], "v", probs, ranges).collect()) == sorted(want.collect())


def test_columns_are_scaled_in_few_scans(spark, data):
    from tripweave.operators.columns import fill_with_median
    from tripweave.operators.scaling import min_max_many, robust_z, robust_z_many

    df = spark.read.parquet(f"{data}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cols = {c: f"{c}_z" for c in df.columns}
    scans = lambda x: x._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")
    assert scans(min_max_many(df, cols)) <= 2
    many, one = robust_z_many(df, cols), df
    assert scans(many) <= 4 and scans(fill_with_median(df, *df.columns)) <= 4
    for c, out in cols.items():
        one = robust_z(one, c, out)
    got, want = many.groupBy().sum(*cols.values()).first(), one.groupBy().sum(*cols.values()).first()
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got, want))


def test_surrogate_keys_do_not_meet(spark):
    from pyspark.sql import functions as F
    from tripweave.functions.text import surrogate_key

    odd = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("~", "c"), ("a\\", "|c"), ("a", "\\|c"), ("a|", "c")], "x string, y string")
    many = spark.range(300_000).selectExpr("cast(id as string) as x", "cast(id % 7 as string) as y")
    for df in (odd, many):
        assert df.select(surrogate_key("K", F.col("x"), F.col("y"))).distinct().count() == df.count()


def test_status_report_adds_up(spark):
    from tripweave.operators.aggregates import status_report

    df = spark.createDataFrame([("ok",), ("bad 1",), (None,), (None,), ("odd",)], "s string")
    got = {r[0]: r[1] for r in status_report(df, "s", {"Good": "ok"}, {"Bad": "bad"}, "Other: ").collect()}
    assert got == {"Total Records": 5, "Good": 1, "Bad": 1, "Other: (none)": 2, "Other: odd": 1}


def test_one_dense_pair_of_cells_makes_many_tasks(spark):
    from tripweave.operators.dedup import cluster_points

    points = [("g", i * 1e-4, 0.001 * (i % 9), 1.0) for i in range(1500)] + [("g", 1.1 + i * 1e-4, 0.001 * (i % 7), 1.0) for i in range(1500)]
    df = spark.createDataFrame(points, "g string, x double, y double, e double")
    assert cluster_points(df, ["g"], "x", "y", "e").select("cluster").distinct().count() == 1


def test_long_edge_through_a_small_polygon(spark):
    from tripweave.operators.spatial import edges_near

    pt = "array(named_struct('x', {0}, 'y', {1}), named_struct('x', {2}, 'y', {3}))".format
    edges = spark.sql(f"select 1 as e, {pt('0D', '0D', '1000D', '0D')} as line union all select 2, {pt('0D', '40D', '1000D', '40D')} union all select 3, {pt('0D', '34D', '1000D', '34D')}")
    box = [(240.0, -10.0), (260.0, -10.0), (260.0, 10.0), (240.0, 10.0), (240.0, -10.0)]
    shapes = spark.createDataFrame([(9, [box])], "s int, rings array<array<struct<x: double, y: double>>>")
    assert sorted(r.e for r in edges_near(edges, "e", "line", shapes, "rings", 25.0).collect()) == [1, 3]


def test_edges_near_with_no_radius(spark):
    """A long line and a radius of 0: no flood of points, and the pairs that touch."""
    from tripweave.operators.spatial import edges_near

    line = "array(struct(0.0d as x, 5.0d as y), struct(1000.0d as x, 5.0d as y))"
    away = "array(struct(0.0d as x, 11.0d as y), struct(1000.0d as x, 11.0d as y))"
    edges = spark.sql(f"select 1 as e, {line} as line union all select 2, {away}")
    ring = [(400.0, 0.0), (410.0, 0.0), (410.0, 10.0), (400.0, 10.0), (400.0, 0.0)]
    shapes = spark.createDataFrame([(7, [ring])], f"s int, rings {RINGS}")
    for radius, want in ((0.0, [1]), (1e-6, [1]), (1.0, [1, 2])):
        assert sorted(r.e for r in edges_near(edges, "e", "line", shapes, "rings", radius).collect()) == want


def plain_union(polygons):
    """Area of a union of simple polygons, in fractions."""
    from fractions import Fraction as Q

    sides = [[(tuple(map(Q, a)), tuple(map(Q, b))) for a, b in zip(p, p[1:])] for p in polygons]
    ys = {v[1] for p in sides for s in p for v in s}
    flat = [s for p in sides for s in p]
    for i, (a, b) in enumerate(flat):
        for c, d in flat[:i]:
            turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if turn:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / turn
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / turn
                if 0 <= t <= 1 and 0 <= u <= 1:
                    ys.add(a[1] + t * (b[1] - a[1]))
    ys, total = sorted(ys), Q(0)
    for lo, hi in zip(ys, ys[1:]):
        mid, spans = (lo + hi) / 2, []
        for p in sides:
            xs = sorted(a[0] + (b[0] - a[0]) * (mid - a[1]) / (b[1] - a[1]) for a, b in p if (a[1] > mid) != (b[1] > mid))
            spans += zip(xs[::2], xs[1::2])
        end = None
        for x0, x1 in sorted(spans):
            start = x0 if end is None else max(x0, end)
            total += max(Q(0), x1 - start) * (hi - lo)
            end = x1 if end is None else max(end, x1)
    return float(total)


def test_union_area_of_slanted_shapes_is_exact(spark):
    import random

    rng = random.Random(6)
    tri = lambda: [(rng.randint(0, 40) / 4, rng.randint(0, 40) / 4) for _ in range(3)]
    groups = {"two": [[(0, 0), (4, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (4, 4), (0, 0)]], "same": [[(0, 0), (3, 0), (1, 2), (0, 0)]] * 3}
    for k in range(6):
        groups[f"r{k}"] = [t + t[:1] for t in (tri() for _ in range(2 + 4 * k))]
    data = [(k, [[(float(x), float(y)) for x, y in p]]) for k, ps in groups.items() for p in ps] + [("flat", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]])]
    out = dict(rows(spatial.union_area(spark.createDataFrame(data, f"k string, rings {RINGS}"), ["k"], "rings", "area")))
    assert abs(out["two"] - 12) < 1e-12 and abs(out["same"] - 3) < 1e-12 and out["flat"] == 0
    for k, ps in groups.items():
        assert abs(out[k] - plain_union(ps)) < 1e-9


def test_pass_rates_and_passers(spark):
    from tripweave.operators.survey import pass_rates, passers

    kind = "person_id int, vc_pass int, retest_match int, verdict string"
    quality = spark.createDataFrame([(1, 1, 1, "keep"), (2, 1, 0, "flag"), (2, 0, 0, "remove"), (3, 0, 1, "flag")], kind)
    assert tuple(pass_rates(quality).first()) == (4, 2, 0.5, 2, 0.5, 1, 2, 1)
    assert [r.person_id for r in passers(quality).collect()] == [1]
    assert tuple(pass_rates(quality.limit(0)).first()) == (0, 0, None, 0, None, 0, 0, 0)


def test_sector_lookup_and_image_capacity(spark):
    from tripweave.operators.lookup import sector_lookup
    from tripweave.operators.perception import image_capacity

    homes = spark.createDataFrame([(1, "0512"), (2, "99"), (3, None)], "id int, postal string")
    sectors = spark.createDataFrame([("05", " Bedok "), ("07", "None")], "code string, area string")
    stats = spark.createDataFrame([("BEDOK", 4.5)], "name string, time double")
    assert sorted(map(tuple, sector_lookup(homes, "postal", sectors, "code", "area", stats, "name", ["time"]).collect()), key=repr) == [
        (1, "0512", "05", 4.5), (2, "99", "99", None), (3, None, None, None)]
    images = spark.createDataFrame([("1_a",)] * 60 + [("x_b",)] * 3, "place string")
    assert {tuple(r) for r in image_capacity(images, "place").collect()} == {("1_a", 60, 20, 50), ("x_b", 3, 15, 3)}


def test_union_area_of_many_shapes_makes_strips_of_their_height_and_broadcasts_none(spark):
    rng = random.Random(11)
    boxes = [(rng.randint(0, 180), rng.randint(0, 180)) for _ in range(600)]
    ring = [[[(float(x), float(y)), (x + 30.0, float(y)), (x + 30.0, y + 20.0), (float(x), y + 20.0), (float(x), float(y))]] for x, y in boxes]
    df = spark.createDataFrame([("k", r) for r in ring], "k string, rings array<array<struct<x: double, y: double>>>")
    boxed = df.select("k", geo.bounding_box(F.col("rings")).alias("_box"))
    assert spatial._strips(boxed, ["k"]).first()["_strip"] == 20.0
    out = spatial.union_area(df, ["k"], "rings", "area")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [k#") >= 2  # slabs, and crossings of sides
    cells = {(x + i, y + j) for x, y in boxes for i in range(30) for j in range(20)}
    assert out.first()["area"] == pytest.approx(float(len(cells)))


def test_heading_gaps_and_distances_of_blocks_match_all_pairs():
    rng = np.random.default_rng(4)
    for low, high in ((0, 360), (0, 900), (90, 90.5)):
        h, oh = rng.uniform(low, high, 40), np.round(rng.uniform(low, high, 70))
        h[:3], oh[:5], h[4] = np.nan, np.nan, oh[9]
        w, ow = rng.integers(1, 5, 40).astype(float), rng.integers(1, 5, 70).astype(float)
        gap = np.abs(h[:, None] - oh)
        gap = np.nan_to_num(np.minimum(gap, 360 - gap))
        total, top = pairwise._turns(h, oh, ow)
        assert total == pytest.approx(gap @ ow, abs=1e-8) and top == pytest.approx(gap.max(axis=1), abs=1e-12)
    assert [a.tolist() for a in pairwise._turns(np.full(3, 0.1), np.full(7, 0.1), np.ones(7))] == [[0.0] * 3, [0.0] * 3]
    for scale in (1.0, 1e-200, 1e200):
        (x, y, u, v), (ox, oy, ou, ov) = rng.normal(size=(4, 40)) * scale, rng.normal(size=(4, 70)) * scale
        mine, theirs = pairwise._gaps(x, y, w, u, v, (ox, oy, ow, ou, ov), True)
        gap, near = np.hypot(x[:, None] - ox, y[:, None] - oy), np.exp(-0.5 * ((u[:, None] - ou) ** 2 + (v[:, None] - ov) ** 2))
        for got, want in ((mine, (gap @ ow, gap.max(axis=1), near @ ow)), (theirs, (w @ gap, gap.max(axis=0), w @ near))):
            for a, b in zip(got, want):
                assert a == pytest.approx(b, rel=1e-12)


def test_blocks_of_a_large_group_do_not_multiply(spark, monkeypatch):
    df = spark.range(4000).selectExpr("'k' AS g", "double(id % 61) AS x", "double(id) AS y", "double(id % 350) AS h")
    made = spark.sparkContext.accumulator(0)
    inner = pairwise._block_sums

    def counted(density):
        add_up = inner(density)

        def run(batches):
            def seen():
                for b in batches:
                    made.add(len(b))
                    yield b
            yield from add_up(seen())

        return run

    monkeypatch.setattr(pairwise, "_block_sums", counted)
    out = pairwise.group_pair_sums(df, "g", "x", "y", "h", block=16, density=False)
    got = out.filter("y = 0").first()
    n = np.arange(4000)
    assert got["spatial"] == pytest.approx(np.hypot(n % 61, n).sum()) and got["density"] is None
    gap = np.minimum(n % 350, 360 - n % 350)
    assert got["angular"] == pytest.approx(gap.sum()) and got["spatial_max"] == pytest.approx(np.hypot(n % 61, n).max())
    assert 0 < made.value <= 100  # 62,500 pairs of blocks of 16


def test_cascade_scores_each_pair_of_names_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        calls.add(1)
        return 100.0

    monkeypatch.setattr(spatial, "token_set_ratio", lambda a, b, at_least: score(a, b))
    places = spark.createDataFrame([(i, "Gamma Plaza", "museum", 225.0 + i / 100, 5.0) for i in range(60)], "poi_id int, name string, subtype string, x double, y double")
    features = spark.createDataFrame([(1, "Gamma West", box(230, 0, 240, 10)), (2, "Gamma East", box(200, 0, 220, 10))], f"osm_id int, feature_name string, rings {RINGS}")
    out = spatial.match_footprints(places, features).collect()
    assert {(r["match_type"], r["n_polygons"], r["footprint_area"]) for r in out} == {("name_match_union", 2, 300.0)} and len(out) == 60
    assert calls.value == 2


def test_within_distance_tells_what_is_inside(spark):
    shapes = spark.createDataFrame([("a", box(0, 0, 10, 10)), ("b", box(10, 0, 20, 10))], f"shape string, rings {RINGS}")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, -1.0, 5.0), (4, 19.0, 9.0)], "id int, x double, y double")
    got = spatial.within_distance(points, "x", "y", shapes, "rings", 2.0, inside="held")
    want = got.withColumn("plain", geo.contains(F.col("rings"), F.col("x"), F.col("y"))).collect()
    assert {(r["id"], r["shape"], r["held"]) for r in want} == {(1, "a", True), (2, "a", False), (2, "b", False), (3, "a", False), (4, "b", True)}
    assert all(r["held"] == r["plain"] for r in want)

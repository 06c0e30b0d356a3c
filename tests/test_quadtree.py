"""Quadtree joins against plain geometry, with skew, borders, holes and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.operators import quadtree, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*corners):
    return [*corners, corners[0]]


def box(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def star(x, y, r, corners):
    turn = [2 * math.pi * i / corners for i in range(corners)]
    return ring(*[(x + (r if i % 2 else r / 3) * math.cos(t), y + (r if i % 2 else r / 3) * math.sin(t)) for i, t in enumerate(turn)])


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(quadtree, "LEAF_POINTS", 25)
    monkeypatch.setattr(quadtree, "LEAF_WORK", 64)


@pytest.fixture
def scene(spark):
    """Nine tenths of the points lie in one star with a hole; others on borders, corners, far away."""
    r = random.Random(5)
    pts = [(i, r.gauss(500, 60), r.gauss(500, 60)) for i in range(700)]
    pts += [(1000 + i, float(r.randrange(0, 1024, 8)), float(r.randrange(0, 1024, 8))) for i in range(150)]
    pts += [(2000 + i, 512.25, 500.5) for i in range(60)]  # one place
    pts += [(3000, 64.0, 64.0), (3001, 128.0, 96.0), (3002, 5000.0, 5.0), (3003, None, 1.0), (3004, float("nan"), 1.0), (3005, 1.0, float("inf"))]
    shapes = [("star", [star(500, 500, 450, 60), box(480, 480, 520, 520)[::-1]]), ("cell", [box(64, 64, 128, 128)])]
    shapes += [(f"s{i}", [star(r.uniform(0, 1000), r.uniform(0, 1000), r.uniform(5, 60), 8)]) for i in range(25)]
    shapes += [("dot", [[(300.0, 300.0)] * 2]), ("none", None), ("empty", [])]
    return spark.createDataFrame(pts, "pid int, px double, py double"), spark.createDataFrame(shapes, f"zone string, rings {RINGS}")


def plain(points, shapes, radius):
    """Every pair by the column functions on whole rings; small tables only."""
    p = points.filter("px is not null and not isnan(px) and py < 1e9")
    s = shapes.filter("size(rings) > 0")
    gap = geo.polygon_distance(F.col("rings"), F.col("px"), F.col("py"))
    far = p.join(s, F.lit(True)).select("pid", "zone", gap.alias("dist")).filter(F.col("dist") <= radius)
    return sorted(map(tuple, far.collect()))


@pytest.mark.parametrize("radius", [0.0, 7.5])
def test_distances_equal_whole_rings(scene, small_leaves, radius):
    points, shapes = scene
    out = spatial.within_distance(points, "px", "py", shapes, "rings", radius).select("pid", "zone", "dist")
    assert sorted(map(tuple, out.collect())) == plain(points, shapes, radius)


@pytest.mark.parametrize("rounds", [2, 4])
def test_rounds_go_on_below_the_first(scene, small_leaves, monkeypatch, rounds):
    monkeypatch.setattr(quadtree, "ROUND", rounds)
    points, shapes = scene
    out = spatial.within_distance(points, "px", "py", shapes, "rings", 7.5).select("pid", "zone", "dist")
    assert sorted(map(tuple, out.collect())) == plain(points, shapes, 7.5)


def test_a_tree_that_may_not_grow_is_still_right(scene, small_leaves, monkeypatch):
    monkeypatch.setattr(quadtree, "MOST_NODES", 40)
    monkeypatch.setattr(quadtree, "ROUND", 4)
    points, shapes = scene
    out = spatial.within_distance(points, "px", "py", shapes, "rings", 7.5).select("pid", "zone", "dist")
    assert sorted(map(tuple, out.collect())) == plain(points, shapes, 7.5)


def test_first_shape_holding_a_point(scene, small_leaves):
    points, shapes = scene
    out = dict(map(tuple, spatial.point_in_polygon(points, "pid", "px", "py", shapes, "rings", "zone", ["zone"]).select("pid", "zone").collect()))
    p = points.filter("px is not null and not isnan(px) and py < 1e9")
    held = p.join(shapes.filter("size(rings) > 0"), F.lit(True)).filter(geo.contains(F.col("rings"), F.col("px"), F.col("py")))
    first = dict(map(tuple, held.groupBy("pid").agg(F.min("zone")).collect()))
    assert {k: v for k, v in out.items() if v is not None} == first
    assert len(out) == points.count()


def tree_of(points):
    one = F.lit(1).cast("bigint")
    spots = points.filter("px between 0 and 1024 and py between 0 and 1024")
    return quadtree.tree(spots.select(F.col("px").alias("_x"), F.col("py").alias("_y"), one.alias("_points"), one.alias("_shapes")), 10)


def test_leaves_take_every_point_once_and_no_key_is_crowded(scene, small_leaves):
    points, _ = scene
    nodes, levels = tree_of(points)
    inside = points.filter("px between 0 and 1024 and py between 0 and 1024")
    at = inside.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])))
    at = at.withColumn("_cx", quadtree._cell(F.col("px"), F.col("_level"))).withColumn("_cy", quadtree._cell(F.col("py"), F.col("_level")))
    dealt = at.join(nodes.filter("_leaf"), quadtree.CELL)
    assert dealt.count() == inside.count() == dealt.select("pid").distinct().count()
    keys = dealt.groupBy(*quadtree.CELL, "_salts", F.pmod(F.xxhash64("pid", "px", "py"), F.col("_salts"))).count()
    assert keys.agg(F.max("count")).first()[0] <= 2 * quadtree.LEAF_POINTS


def test_leaves_inside_a_polygon_keep_no_ring(scene, small_leaves):
    points, shapes = scene
    nodes, levels = tree_of(points)
    leaves = quadtree.cover(shapes.filter("zone = 'star'"), "rings", nodes, levels, 0.0)
    row = leaves.agg(F.sum(F.expr("int(size(_segs) = 0 and _flip)")), F.max(F.size("_segs")), F.count(F.lit(1))).first()
    assert row[0] > 0 and row[1] < 64 and row[2] > row[0]


def test_points_are_shuffled_once(scene):
    points, shapes = scene
    near = spatial.within_distance(points, "px", "py", shapes, "rings", 5.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sides", [(False, True), (True, False)])
def test_empty_tables(scene, sides):
    points, shapes = scene
    points, shapes = (points.limit(0) if sides[0] else points), (shapes.limit(0) if sides[1] else shapes)
    assert spatial.within_distance(points, "px", "py", shapes, "rings", 5.0).count() == 0
    out = spatial.point_in_polygon(points, "pid", "px", "py", shapes, "rings", "zone", ["zone"])
    assert out.count() == points.count() and out.filter("zone is not null").count() == 0

"""Lines clipped to grown polygons."""

import math
import random

import pytest

from tripweave.operators.spatial import clip_edges, edges_near

RINGS = "array<array<struct<x: double, y: double>>>"
LINE = "array<struct<x: double, y: double>>"


def clip(spark, lines, shapes, radius):
    edges = spark.createDataFrame(lines, f"e int, line {LINE}")
    zones = spark.createDataFrame(shapes, f"s int, rings {RINGS}")
    out = clip_edges(edges, "e", "line", zones, "rings", radius)
    return {(r.e, r.s, r.piece): ([(p.x, p.y) for p in r.part], r.length) for r in out.collect()}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def plain_distance(rings, x, y):
    inside, best = False, math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return 0.0 if inside else best


def test_pieces_of_a_box(spark):
    """Round corners, a corner of the line inside, and a line that leaves and comes back."""
    lines = [
        (1, [(-50.0, 5.0), (50.0, 5.0)]),
        (2, [(-5.0, 5.0), (5.0, 5.0), (5.0, 30.0)]),
        (3, [(5.0, 5.0), (5.0, 40.0), (8.0, 40.0), (8.0, 5.0)]),
        (4, [(-50.0, 13.0), (50.0, 13.0)]),
        (5, [(-50.0, 13.5), (50.0, 13.5)]),
    ]
    out = clip(spark, lines, [(9, [box(0.0, 0.0, 10.0, 10.0)])], 3.0)
    assert set(out) == {(1, 9, 1), (2, 9, 1), (3, 9, 1), (3, 9, 2), (4, 9, 1)}
    assert out[1, 9, 1][0] == [pytest.approx((-3.0, 5.0)), pytest.approx((13.0, 5.0))]
    assert out[2, 9, 1][0] == [pytest.approx((-3.0, 5.0)), pytest.approx((5.0, 5.0)), pytest.approx((5.0, 13.0))]
    assert out[3, 9, 2][0] == [pytest.approx((8.0, 13.0)), pytest.approx((8.0, 5.0))]
    assert out[4, 9, 1][1] == pytest.approx(10.0)


def test_no_radius_and_odd_lines(spark):
    """Radius 0 clips to the polygon; touching corners, points, empty lines and nulls give nothing."""
    lines = [
        (1, [(-5.0, 5.0), (50.0, 5.0)]), (2, [(-5.0, 5.0), (5.0, -5.0)]), (3, [(5.0, 5.0), (5.0, 5.0)]),
        (4, []), (5, None), (6, [(2.0, 10.0), (8.0, 10.0)]), (7, [(5.0, 5.0)]),
    ]
    out = clip(spark, lines, [(9, [box(0.0, 0.0, 10.0, 10.0)])], 0.0)
    twice = [(1, [(-50.0, -2.0), (-1.0, -2.0), (-1.0, -2.0), (50.0, -2.0)])]
    assert {k[2]: len(v[0]) for k, v in clip(spark, twice, [(9, [box(0.0, 0.0, 10.0, 10.0)])], 3.0).items()} == {1: 4}
    assert {k: v[1] for k, v in out.items()} == {(1, 9, 1): pytest.approx(10.0), (6, 9, 1): pytest.approx(6.0)}
    assert clip(spark, lines[:1], [], 5.0) == {} and clip(spark, [], [(9, [box(0.0, 0.0, 1.0, 1.0)])], 5.0) == {}


def test_random_shapes_against_dense_points(spark):
    rng = random.Random(5)
    shapes = []
    for s in range(4):
        cx, cy = rng.uniform(0, 40), rng.uniform(0, 40)
        outer = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((i * math.pi / 4, rng.uniform(8, 20)) for i in range(8))]
        shapes.append((s, [outer + outer[:1], box(cx - 3, cy - 3, cx + 3, cy + 3)[::-1]]))
    lines = [(e, [(rng.uniform(-30, 70), rng.uniform(-30, 70)) for _ in range(3)]) for e in range(8)]
    radius, steps = 2.0, 4000
    out = clip(spark, lines, shapes, radius)
    total = {}
    for (e, s, _), (part, length) in out.items():
        total[e, s] = total.get((e, s), 0.0) + length
        assert all(plain_distance(dict(shapes)[s], x, y) <= radius + 1e-7 for x, y in part)
    for e, line in lines:
        for s, rings in shapes:
            want = 0.0
            for (ax, ay), (bx, by) in zip(line, line[1:]):
                near = sum(plain_distance(rings, ax + (bx - ax) * (i + 0.5) / steps, ay + (by - ay) * (i + 0.5) / steps) <= radius for i in range(steps))
                want += near / steps * math.hypot(bx - ax, by - ay)
            assert total.get((e, s), 0.0) == pytest.approx(want, abs=0.3)
    edges = spark.createDataFrame(lines, f"e int, line {LINE}")
    zones = spark.createDataFrame(shapes, f"s int, rings {RINGS}")
    assert set(total) == {(r.e, r.s) for r in edges_near(edges, "e", "line", zones, "rings", radius).collect()}

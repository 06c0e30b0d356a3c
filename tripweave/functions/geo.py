"""Bearings, projection and ring geometry as plain column expressions.

A polygon is ``rings array<array<struct<x,y>>>``: outer rings run counter-clockwise,
holes clockwise (see ``orient``), and each ring repeats its first vertex at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: WGS84 ellipsoid and the SVY21 transverse-Mercator grid ---
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
ORIGIN_LAT = 1 + 22 / 60
ORIGIN_LON = 103 + 50 / 60
FALSE_EASTING = 28001.642
FALSE_NORTHING = 38744.572

_E2 = 2 * FLATTENING - FLATTENING**2
_EP2 = _E2 / (1 - _E2)
_M0 = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
_M2 = 3 / 8 * (_E2 + _E2**2 / 4 + 15 * _E2**3 / 128)
_M4 = 15 / 256 * (_E2**2 + 3 * _E2**3 / 4)
_M6 = 35 * _E2**3 / 3072


def _meridian(phi):
    """Arc length from the equator; works on floats and Columns."""
    sin = math.sin if isinstance(phi, float) else F.sin
    return SEMI_MAJOR * (_M0 * phi - _M2 * sin(2 * phi) + _M4 * sin(4 * phi) - _M6 * sin(6 * phi))


_ARC_ORIGIN = _meridian(math.radians(ORIGIN_LAT))


def to_metric(lat: Column, lon: Column) -> Column:
    """WGS84 degrees to ``struct<x_m, y_m>`` on the grid (published series)."""
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = SEMI_MAJOR / F.sqrt(1 - _E2 * sin * sin)
    t = tan * tan
    c = _EP2 * cos * cos
    a = (F.radians(lon) - math.radians(ORIGIN_LON)) * cos
    a2 = a * a
    east = nu * a * (1 + a2 * (1 - t + c) / 6 + a2 * a2 * (5 - 18 * t + t * t + 72 * c - 58 * _EP2) / 120)
    north = (
        _meridian(phi)
        - _ARC_ORIGIN
        + nu * tan * a2 * (0.5 + a2 * (5 - t + 9 * c + 4 * c * c) / 24
                           + a2 * a2 * (61 - 58 * t + t * t + 600 * c - 330 * _EP2) / 720)
    )
    return F.struct((east + FALSE_EASTING).alias("x_m"), (north + FALSE_NORTHING).alias("y_m"))


def to_wgs84(x_m: Column, y_m: Column) -> Column:
    """Grid metres to ``struct<lat, lon>`` in degrees."""
    mu = (y_m - FALSE_NORTHING + _ARC_ORIGIN) / (SEMI_MAJOR * _M0)
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    foot = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + 151 * e1**3 / 96 * F.sin(6 * mu)
        + 1097 * e1**4 / 512 * F.sin(8 * mu)
    )
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    c = _EP2 * cos * cos
    t = tan * tan
    w = 1 - _E2 * sin * sin
    nu = SEMI_MAJOR / F.sqrt(w)
    rho = SEMI_MAJOR * (1 - _E2) / (w * F.sqrt(w))
    d = (x_m - FALSE_EASTING) / nu
    d2 = d * d
    lat = foot - nu * tan / rho * d2 * (
        0.5
        - d2 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) / 24
        + d2 * d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) / 720
    )
    lon = d / cos * (
        1
        - d2 * (1 + 2 * t + c) / 6
        + d2 * d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) / 120
    )
    return F.struct(
        F.degrees(lat).alias("lat"), (F.degrees(lon) + ORIGIN_LON).alias("lon")
    )


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, degrees in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smaller angle between two headings; a missing or negative heading gives 0."""
    d = F.abs(a - b)
    return F.when((a >= 0) & (b >= 0), F.least(d, 360 - d)).otherwise(0.0)


def degree_box(lat: Column, lon: Column, radius_m) -> Column:
    """Square box of ``radius_m`` around a point, 111 km to the degree."""
    r = radius_m / 111000 if isinstance(radius_m, Column) else F.lit(radius_m / 111000)
    return F.struct(
        (lon - r).alias("west"), (lat - r).alias("south"), (lon + r).alias("east"), (lat + r).alias("north")
    )


# ---------------------------------------------------------------- rings


def _ends(ring: Column) -> Column:
    return F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))


def segments(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring or line: ``array<struct<x0,y0,x1,y1>>``."""
    starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(
        starts,
        _ends(ring),
        lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")),
    )


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def line_length(line: Column) -> Column:
    """Length of a line or ring."""
    return _sum(F.transform(segments(line), lambda s: F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area: positive when counter-clockwise."""
    origin = ring[0]
    return _sum(
        F.transform(
            segments(ring),
            lambda s: ((s["x0"] - origin["x"]) * (s["y1"] - origin["y"])
                       - (s["x1"] - origin["x"]) * (s["y0"] - origin["y"])) / 2,
        )
    )


def polygon_area(rings: Column) -> Column:
    """Area of oriented rings; clockwise holes subtract."""
    return _sum(F.transform(rings, ring_area))


def orient(outer: Column, holes: Column) -> Column:
    """Rings in the library's orientation from outer rings and holes of any direction."""
    turned_out = F.transform(outer, lambda r: F.when(ring_area(r) < 0, F.reverse(r)).otherwise(r))
    turned_in = F.transform(holes, lambda r: F.when(ring_area(r) > 0, F.reverse(r)).otherwise(r))
    return F.concat(turned_out, turned_in)


def polygon_centroid(rings: Column) -> Column:
    """Area-weighted centroid ``struct<x, y>``."""
    origin = rings[0][0]

    def moment(axis: str) -> Column:
        return _sum(
            F.transform(
                F.flatten(F.transform(rings, segments)),
                lambda s: ((s[f"{axis}0"] - origin[axis]) + (s[f"{axis}1"] - origin[axis]))
                * ((s["x0"] - origin["x"]) * (s["y1"] - origin["y"])
                   - (s["x1"] - origin["x"]) * (s["y0"] - origin["y"])) / 6,
            )
        )

    area = polygon_area(rings)
    return F.struct(
        (origin["x"] + F.try_divide(moment("x"), area)).alias("x"),
        (origin["y"] + F.try_divide(moment("y"), area)).alias("y"),
    )


def bounding_box(rings: Column) -> Column:
    """``struct<x0,y0,x1,y1>`` of all vertices."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
    )


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd point-in-polygon test; a point on the boundary is outside."""
    segs = F.flatten(F.transform(rings, segments))
    crossings = F.size(
        F.filter(
            segs,
            lambda s: ((s["y0"] > y) != (s["y1"] > y))
            & (x < (s["x1"] - s["x0"]) * (y - s["y0"]) / F.nullif(s["y1"] - s["y0"], F.lit(0.0)) + s["x0"]),
        )
    )
    on_edge = F.exists(
        segs,
        lambda s: ((s["x1"] - s["x0"]) * (y - s["y0"]) == (s["y1"] - s["y0"]) * (x - s["x0"]))
        & x.between(F.least(s["x0"], s["x1"]), F.greatest(s["x0"], s["x1"]))
        & y.between(F.least(s["y0"], s["y1"]), F.greatest(s["y0"], s["y1"])),
    )
    return (crossings % 2 == 1) & ~on_edge


def edge_distance(segs: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest of ``array<struct<x0,y0,x1,y1>>``."""

    def one(s: Column) -> Column:
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        along = F.coalesce(F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.greatest(F.least(along, F.lit(1.0)), F.lit(0.0))
        return F.hypot(x - s["x0"] - along * dx, y - s["y0"] - along * dy)

    return F.array_min(F.transform(segs, one))


def polygon_distance(rings: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the boundary."""
    segs = F.flatten(F.transform(rings, segments))
    return F.when(contains(rings, x, y), 0.0).otherwise(edge_distance(segs, x, y))


def _side(ax, ay, bx, by, px, py) -> Column:
    """Sign of the turn from a over b to p."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segment_polygon_distance(seg: Column, rings: Column) -> Column:
    """Distance of a segment (struct x0, y0, x1, y1) to a polygon; 0 if they meet.

    Segments that do not cross are closest at an end point of one of them, so the ends of the
    segment against the polygon and the polygon's corners against the segment are enough.
    """
    ends = F.least(polygon_distance(rings, seg["x0"], seg["y0"]), polygon_distance(rings, seg["x1"], seg["y1"]))
    corners = F.array_min(F.transform(F.flatten(rings), lambda p: edge_distance(F.array(seg), p["x"], p["y"])))
    s = seg

    def crosses(e: Column) -> Column:
        a = _side(s["x0"], s["y0"], s["x1"], s["y1"], e["x0"], e["y0"]) * _side(s["x0"], s["y0"], s["x1"], s["y1"], e["x1"], e["y1"])
        b = _side(e["x0"], e["y0"], e["x1"], e["y1"], s["x0"], s["y0"]) * _side(e["x0"], e["y0"], e["x1"], e["y1"], s["x1"], s["y1"])
        return (a < 0) & (b < 0)

    meets = F.exists(F.flatten(F.transform(rings, segments)), crosses)
    return F.when(meets, 0.0).otherwise(F.least(ends, corners))


def scan_crossings(rings: Column, y: Column) -> Column:
    """Sorted x of the crossings of a horizontal line with all rings."""
    hits = F.filter(
        F.flatten(F.transform(rings, segments)), lambda s: (s["y0"] > y) != (s["y1"] > y)
    )
    return F.array_sort(
        F.transform(
            hits, lambda s: s["x0"] + (s["x1"] - s["x0"]) * (y - s["y0"]) / F.nullif(s["y1"] - s["y0"], F.lit(0.0))
        )
    )


def interior_point(rings: Column) -> Column:
    """A point inside: middle of the widest span on the horizontal line through the box middle."""
    box = bounding_box(rings)
    mid = (box["y0"] + box["y1"]) / 2
    xs = scan_crossings(rings, mid)
    spans = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(xs) / 2, F.lit(1)).cast("int")),
        lambda i: F.struct(
            (F.try_element_at(xs, 2 * i) - F.try_element_at(xs, 2 * i - 1)).alias("width"),
            ((F.try_element_at(xs, 2 * i) + F.try_element_at(xs, 2 * i - 1)) / 2).alias("x"),
        ),
    )
    return F.struct(F.array_max(spans)["x"].alias("x"), mid.alias("y"))


def regular_ring(x: Column, y: Column, radius, corners: int = 32) -> Column:
    """Closed counter-clockwise ring of ``corners`` vertices around a point."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(corners)),
        lambda i: F.struct(
            (x + radius * F.cos(2 * math.pi * (i % corners) / corners)).alias("x"),
            (y + radius * F.sin(2 * math.pi * (i % corners) / corners)).alias("y"),
        ),
    )


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise rectangle."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])


# ---------------------------------------------------------------- clipping

#: Shares of a segment closer than this are one place.
SHARE_EPS = 1e-12


def _interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("t0"), hi.alias("t1"))


def _linear(at: Column, step: Column, lo: Column, hi: Column) -> Column:
    """Interval of t with ``lo <= at + t * step <= hi``, not yet cut to 0..1; t0 > t1 if empty."""
    a, b = F.try_divide(lo - at, step), F.try_divide(hi - at, step)
    still = F.when(at.between(lo, hi), _interval(F.lit(0.0), F.lit(1.0))).otherwise(_interval(F.lit(1.0), F.lit(0.0)))
    return F.when(step == 0, still).otherwise(_interval(F.least(a, b), F.greatest(a, b)))


def merge_intervals(intervals: Column) -> Column:
    """Union of ``array<struct<t0,t1>>``: sorted, disjoint, those that touch joined."""

    def add(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = _interval(last["t0"], F.greatest(last["t1"], v["t1"]))
        return (
            F.when(F.size(acc) == 0, F.array(v))
            .when(v["t0"] <= last["t1"] + SHARE_EPS, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)))
            .otherwise(F.concat(acc, F.array(v)))
        )

    return F.aggregate(F.array_sort(intervals), F.lit([]).cast("array<struct<t0:double,t1:double>>"), add)


def buffer_intervals(seg: Column, rings: Column, radius: float) -> Column:
    """Parts of a segment (struct x0, y0, x1, y1) at most ``radius`` from a polygon, as shares of its length.

    The grown polygon is the polygon itself, a strip along every side and a disc at every corner.
    Between two crossings with the boundary a segment is wholly inside or outside, so one middle
    point decides; strips and discs give one interval each. Corners are round, not many-sided.
    """
    dx, dy = seg["x1"] - seg["x0"], seg["y1"] - seg["y0"]
    sides = F.flatten(F.transform(rings, segments))
    r = F.lit(float(radius))

    def crossing(s: Column) -> Column:
        ex, ey = s["x1"] - s["x0"], s["y1"] - s["y0"]
        turn = dx * ey - dy * ex
        t = F.try_divide((s["x0"] - seg["x0"]) * ey - (s["y0"] - seg["y0"]) * ex, turn)
        u = F.try_divide((s["x0"] - seg["x0"]) * dy - (s["y0"] - seg["y0"]) * dx, turn)
        return F.when(t.between(0.0, 1.0) & u.between(-SHARE_EPS, 1.0 + SHARE_EPS), t)

    met = F.filter(F.transform(sides, crossing), lambda t: t.isNotNull())
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met)))
    # a lambda names the cuts, so that they are computed once
    spans = F.transform(
        F.array(cuts), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), _interval)
    )[0]
    inner = F.filter(
        spans,
        lambda v: contains(rings, seg["x0"] + dx * (v["t0"] + v["t1"]) / 2, seg["y0"] + dy * (v["t0"] + v["t1"]) / 2),
    )

    def strip(s: Column) -> Column:
        ex, ey = s["x1"] - s["x0"], s["y1"] - s["y0"]
        size = F.nullif(F.hypot(ex, ey), F.lit(0.0))
        fx, fy = seg["x0"] - s["x0"], seg["y0"] - s["y0"]
        along = _linear((fx * ex + fy * ey) / size, (dx * ex + dy * ey) / size, F.lit(0.0), size)
        across = _linear((fy * ex - fx * ey) / size, (dy * ex - dx * ey) / size, -r, r)
        return _interval(F.greatest(along["t0"], across["t0"]), F.least(along["t1"], across["t1"]))

    def disc(p: Column) -> Column:
        fx, fy = seg["x0"] - p["x"], seg["y0"] - p["y"]
        a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - r * r
        root = F.when(b * b >= a * c, F.sqrt(b * b - a * c))
        still = F.when((a == 0) & (c <= 0), 0.0)  # a segment of one point inside the disc is whole
        return _interval(F.coalesce(still, F.try_divide(-b - root, a)), F.coalesce(still + 1, F.try_divide(-b + root, a)))

    grown = F.concat(inner, F.transform(sides, strip), F.transform(F.flatten(rings), disc))
    # a side without length or a disc not reached has NULL ends; greatest() below would skip them
    real = F.filter(grown, lambda v: v["t0"].isNotNull() & v["t1"].isNotNull())
    cut = F.transform(real, lambda v: _interval(F.greatest(v["t0"], F.lit(0.0)), F.least(v["t1"], F.lit(1.0))))
    real = F.filter(cut, lambda v: v["t1"] - v["t0"] > SHARE_EPS)
    return merge_intervals(real)


def line_part(line: Column, start: Column, end: Column) -> Column:
    """Part of a line between two positions; position i + t is share t of segment i (from 0)."""

    def at(s: Column) -> Column:
        i = F.least(F.floor(s), F.size(line) - F.lit(2)).cast("int")
        a, b, t = F.get(line, i), F.get(line, i + 1), s - i
        return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))

    first = F.floor(start).cast("int") + 1
    between = F.slice(line, first + 1, F.greatest(F.ceil(end).cast("int") - first, F.lit(0)))
    return F.concat(F.array(at(start)), between, F.array(at(end)))

"""Spatial joins, sampling and areas on plain coordinates.

Catalyst has no spatial index, so polygons and points meet on cell keys: on the leaves of an
adaptive quadtree (``quadtree``), or, for points along edges, on grids by the polygons' sizes, where
a polygon covers at most nine cells and points are keyed once per grid in use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions import geo
from tripweave.functions.text import token_set_ratio
from tripweave.operators import quadtree
from tripweave.operators.filters import category_match
from tripweave.session import cut_lineage


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")


def near_pairs(points: DataFrame, x: str, y: str, shapes: DataFrame, box: Column, pad: float = 0.0) -> DataFrame:
    """Point rows joined to shape rows whose box, grown by ``pad``, may hold the point.

    A superset of the pairs within ``pad``; the caller applies the exact predicate. Column
    names of both sides must differ.
    """
    b = shapes.withColumn("_box", box).withColumn(
        "_box",
        F.struct(
            (F.col("_box.x0") - pad).alias("x0"), (F.col("_box.y0") - pad).alias("y0"),
            (F.col("_box.x1") + pad).alias("x1"), (F.col("_box.y1") + pad).alias("y1"),
        ),
    )
    side = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"), F.lit(1e-9))
    b = b.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    levels = b.agg(F.collect_set("_level").alias("_levels"))  # one small integer per grid in use
    b = b.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_box.x0"), F.col("_level")), _cell(F.col("_box.x1"), F.col("_level")))))
    b = b.withColumn("_cy", F.explode(F.sequence(_cell(F.col("_box.y0"), F.col("_level")), _cell(F.col("_box.y1"), F.col("_level")))))
    p = (
        points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
        .withColumn("_cx", _cell(F.col(x), F.col("_level"))).withColumn("_cy", _cell(F.col(y), F.col("_level")))
    )
    inside = F.col(x).between(F.col("_box.x0"), F.col("_box.x1")) & F.col(y).between(F.col("_box.y0"), F.col("_box.y1"))
    return p.join(b, ["_level", "_cx", "_cy"]).filter(inside).drop("_level", "_cx", "_cy", "_box")


def point_in_polygon(points: DataFrame, key: str, x: str, y: str, shapes: DataFrame, rings: str,
                     order: str, take: Sequence[str]) -> DataFrame:
    """Left join to the first shape (lowest ``order``) containing each point."""
    slim = shapes.select(F.col(order).alias("_order"), F.col(rings).alias("_rings"), *[F.col(c).alias(f"_t_{c}") for c in take])
    near = quadtree.pairs(points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", slim, "_rings")
    hits = near.filter(quadtree.inside("_x", "_y"))
    first = hits.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"_t_{c}").alias(c) for c in take]), "_order").alias("_first"))
    return points.join(first, key, "left").select(*points.columns, *[F.col(f"_first.{c}").alias(c) for c in take])


def within_distance(points: DataFrame, x: str, y: str, shapes: DataFrame, rings: str, radius: float,
                    out: str = "dist", inside: str | None = None) -> DataFrame:
    """All (point, shape) pairs at most ``radius`` apart, with the distance. ``inside`` names a column that tells
    whether the shape contains the point; a point on its boundary is outside."""
    near = quadtree.pairs(points, x, y, shapes, rings, radius)
    hit = quadtree.inside(f"`{x}`", f"`{y}`")
    if inside is not None:
        near, hit = near.withColumn(inside, F.explode(F.array(hit))), F.col(inside)
    gap = F.when(hit, 0.0).otherwise(geo.edge_distance(F.col("_segs"), F.col(x), F.col(y)))
    # an explode is not pushed down as a filter would be, so the distance is computed once
    return near.withColumn(out, F.explode(F.filter(F.array(gap), lambda g: g <= radius))).drop("_segs", "_flip")


def _near_segments(edges: DataFrame, key: str, line: str, shapes: DataFrame, rings: str, radius: float) -> DataFrame:
    """(key, _i, _seg, shape columns): segments of lines within ``radius`` of a polygon, once a pair.

    Candidates are found by points on every segment, looked up with a reach of their own: the radius, or the
    shapes' mean size or an eighth of the mean segment if larger, so that short reaches do not
    multiply points. The reach covers the gaps, so no pair is missed; exact segment distances decide.
    """
    seg = F.col("_seg")
    length = F.hypot(seg["x1"] - seg["x0"], seg["y1"] - seg["y0"])
    parts = edges.select(key, F.posexplode(geo.segments(F.col(line))).alias("_i", "_seg"))
    box = geo.bounding_box(F.col(rings))
    size = shapes.agg(F.avg(F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]))).first()[0] or 0.0
    mean = parts.agg(F.avg(length)).first()[0] or 0.0
    reach = max(radius, size, mean / 8, 1e-9)
    parts = parts.withColumn("_n", F.greatest(F.ceil(length / (2 * reach)), F.lit(1)))
    share = F.col("_k") / F.col("_n")
    dense = parts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint"))))
    dense = dense.withColumn("_px", seg["x0"] + (seg["x1"] - seg["x0"]) * share).withColumn("_py", seg["y0"] + (seg["y1"] - seg["y0"]) * share)
    near = near_pairs(dense.drop("_k", "_n"), "_px", "_py", shapes, box, radius + reach).drop("_px", "_py")
    names = [c for c in shapes.columns if c != rings]
    pairs = near.groupBy(key, "_i", "_seg", *names).agg(F.any_value(rings).alias(rings))
    return pairs.filter(geo.segment_polygon_distance(seg, F.col(rings)) <= radius)


def edges_near(edges: DataFrame, key: str, line: str, shapes: DataFrame, rings: str, radius: float) -> DataFrame:
    """(edge, shape) pairs of lines that come within ``radius`` of a polygon; the whole line is kept.

    ``key`` names the edge.
    """
    names = [c for c in shapes.columns if c != rings]
    hit = _near_segments(edges, key, line, shapes, rings, radius).select(key, *names).distinct()
    return hit.join(edges, key)


def clip_edges(edges: DataFrame, key: str, line: str, shapes: DataFrame, rings: str, radius: float) -> DataFrame:
    """Pieces of lines inside each polygon grown by ``radius``: key, shape columns, piece, part, length.

    ``part`` is the piece's line, ``piece`` numbers the pieces of a pair from 1 along the line. A line that
    goes on inside over a corner of its own gives one piece. Places where a line only touches the
    grown polygon have no length and give none; so do lines of one point, empty lines and nulls.
    Segments are cut one by one where they meet a polygon; only their shares are gathered by line.
    """
    names = [c for c in shapes.columns if c != rings]
    near = _near_segments(edges, key, line, shapes, rings, radius)
    shares = near.select(key, *names, "_i", F.explode(geo.buffer_intervals(F.col("_seg"), F.col(rings), radius)).alias("_v"))
    spans = shares.groupBy(key, *names).agg(
        F.collect_list(F.struct((F.col("_i") + F.col("_v.t0")).alias("t0"), (F.col("_i") + F.col("_v.t1")).alias("t1"))).alias("_spans")
    )
    pieces = spans.select(key, *names, F.posexplode(geo.merge_intervals(F.col("_spans"))).alias("_p", "_v"))
    cut = pieces.join(edges.select(key, line), key)
    part = geo.line_part(F.col(line), F.col("_v.t0"), F.col("_v.t1"))
    # made by an explode, which no filter is pushed below, so each piece is cut and measured once
    made = F.transform(F.array(part), lambda p: F.struct(p.alias("part"), geo.line_length(p).alias("length")))
    cut = cut.withColumn("_made", F.explode(F.filter(made, lambda m: m["length"] > 0)))
    return cut.select(key, *names, (F.col("_p") + 1).alias("piece"), "_made.part", "_made.length")


def _bin(y: Column) -> Column:
    """Number of the horizontal strip of a key (``_low``, ``_strip``) that holds y."""
    return F.floor((y - F.col("_low")) / F.col("_strip")).cast("bigint")


def _bins(y0: Column, y1: Column) -> Column:
    """Numbers of the strips that reach from y0 to y1."""
    return F.explode(F.sequence(_bin(y0), _bin(y1)))


def _crossing_heights(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _low, _strip, y): heights at which two segments of a key cross. A horizontal segment crosses at the height of its
    ends and two upright ones do not cross, so one side of the join holds slanted segments only."""
    upright = parts.filter("y0 <> y1").withColumn("_bin", _bins(F.least("y0", "y1"), F.greatest("y0", "y1")))
    names = ("x0", "y0", "x1", "y1")
    a = upright.filter("x0 <> x1").select(*keys, "_bin", "_low", "_strip", *[F.col(c).alias(f"a{c}") for c in names])
    b = upright.select(*keys, "_bin", *[F.col(c).alias(f"b{c}") for c in names])
    overlap = F.expr(
        "greatest(ax0, ax1) >= least(bx0, bx1) and greatest(bx0, bx1) >= least(ax0, ax1) and greatest(ay0, ay1) >= least(by0, by1)"
        " and greatest(by0, by1) >= least(ay0, ay1)"
    )
    turn = F.expr("(ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0)")
    met = a.join(b.hint("merge"), [*keys, "_bin"]).filter(overlap).withColumn("_d", turn).filter("_d <> 0")
    met = met.withColumn("_t", F.expr("((bx0 - ax0) * (by1 - by0) - (by0 - ay0) * (bx1 - bx0)) / nullif(_d, 0D)"))
    met = met.withColumn("_u", F.expr("((bx0 - ax0) * (ay1 - ay0) - (by0 - ay0) * (ax1 - ax0)) / nullif(_d, 0D)"))
    return met.filter("_t between 0 and 1 and _u between 0 and 1").select(*keys, "_low", "_strip", F.expr("ay0 + _t * (ay1 - ay0)").alias("y"))


def _strips(boxed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _low, _strip): where a key's horizontal strips begin and how high they are."""
    frame = boxed.groupBy(*keys).agg(
        F.min("_box.y0").alias("_low"), F.max("_box.y1").alias("_high"), F.avg(F.col("_box.y1") - F.col("_box.y0")).alias("_mean"), F.count(F.lit(1)).alias("_many"),
    )
    return frame.select(*keys, "_low", F.greatest("_mean", (F.col("_high") - F.col("_low")) / F.col("_many")).alias("_strip"))


def union_area(df: DataFrame, keys: Sequence[str], rings: str, out: str) -> DataFrame:
    """Area covered by a key's polygons together, overlaps once; exact up to rounding.

    The plane is cut into horizontal slabs at every corner, every crossing of two sides and every border of a
    strip. Inside a slab no sides cross, so the covered width is linear in the height and the slab's area is its
    height times the width at its middle. A polygon meets the slabs of the strips that it reaches;
    strips are as high as a key's polygons are on average, so polygons reach two of them on average at most, and
    never more strips than polygons. Sizes are unknown to the optimizer here, so joins are told not to broadcast. Rows without a polygon are left out.
    """
    keys = list(keys)
    boxed = df.select(*keys, F.col(rings).alias("_rings"), geo.bounding_box(F.col(rings)).alias("_box")).filter("_box.y0 < _box.y1")
    shapes = cut_lineage(boxed.join(_strips(boxed, keys), keys))
    sides = shapes.select(*keys, "_low", "_strip", F.inline(F.flatten(F.transform("_rings", geo.segments))))
    corners = sides.select(*keys, "_low", "_strip", F.explode(F.array("y0", "y1")).alias("y"))
    inner = corners.unionByName(_crossing_heights(sides, keys)).select(*keys, _bin(F.col("y")).alias("_bin"), "y")
    reached = shapes.select(*keys, "_rings", "_box", "_low", "_strip", _bins(F.col("_box.y0"), F.col("_box.y1")).alias("_bin"))
    border = F.explode(F.array(*[F.col("_low") + (F.col("_bin") + k) * F.col("_strip") for k in (0, 1)]))
    heights = inner.unionByName(reached.select(*keys, "_bin", border.alias("y"))).distinct()
    up = Window.partitionBy(*keys, "_bin").orderBy("y")
    slabs = heights.withColumn("_to", F.lead("y").over(up)).filter("_to > y").select(*keys, "_bin", F.col("y").alias("_from"), "_to", ((F.col("y") + F.col("_to")) / 2).alias("_mid"))
    lines = reached.join(slabs.hint("merge"), [*keys, "_bin"]).filter("_mid > _box.y0 and _mid < _box.y1")
    lines = lines.select(*keys, "_from", "_to", geo.scan_crossings(F.col("_rings"), F.col("_mid")).alias("_xs")).filter(F.size("_xs") >= 2)
    spans = lines.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_xs") - 1, F.lit(2)))).select(
        *keys, "_from", "_to", F.element_at("_xs", F.col("_i")).alias("_a"), F.element_at("_xs", F.col("_i") + 1).alias("_b")
    )
    along = Window.partitionBy(*keys, "_from").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("_b").over(along)
    new = F.greatest(F.col("_b") - F.greatest(F.col("_a"), F.coalesce(reach, F.col("_a"))), F.lit(0.0))
    areas = spans.withColumn("_new", new * (F.col("_to") - F.col("_from"))).groupBy(*keys).agg(F.sum("_new").alias(out))
    return df.select(*keys).distinct().join(areas, keys, "left").select(*keys, F.coalesce(out, F.lit(0.0)).alias(out))


def match_footprints(places: DataFrame, features: DataFrame, radius: float = K.NAME_RADIUS_M,
                     threshold: float = K.NAME_THRESHOLD, rules: Mapping = K.CATEGORY_TAG_RULES) -> DataFrame:
    """Footprint of each place by the first stage that succeeds.

    Stages: polygons containing the point; else polygons within ``radius`` whose name
    scores at least ``threshold``; else the largest within ``radius``; else none. All stages
    see only features allowed for the place's subtype. ``places`` is (poi_id, name,
    subtype, x, y), ``features`` is (osm_id, feature_name, tag columns, rings).
    """
    tags = {t: F.col(t) for t in ("amenity", "leisure", "tourism", "shop", "building") if t in features.columns}
    sized = features.withColumn("area", geo.polygon_area(F.col("rings")))
    near = within_distance(places.select("poi_id", "name", "subtype", "x", "y"), "x", "y", sized, "rings", radius, inside="_inside")
    near = near.filter(category_match(F.col("subtype"), tags, rules))
    near = cut_lineage(near.select("poi_id", "osm_id", "name", "feature_name", "rings", "area", "_inside"))
    settled = near.filter("_inside").select("poi_id").distinct()
    # names are scored once per distinct pair, and only for places no polygon contains; the pairs are stored, else the
    # optimizer moves the filter on the score below their grouping, where each row is scored
    open_pairs = near.filter(F.coalesce(F.col("feature_name"), F.lit("")) != "").join(settled, "poi_id", "left_anti")
    names = cut_lineage(open_pairs.select("name", "feature_name").distinct())
    scores = names.withColumn("score", token_set_ratio(F.col("name"), F.col("feature_name"), threshold))
    alike = scores.filter(F.col("score") >= threshold).select("name", "feature_name", F.lit(2).alias("_named"))
    near = near.join(alike, ["name", "feature_name"], "left")
    near = cut_lineage(near.withColumn("stage", F.when(F.col("_inside"), 1).otherwise(F.coalesce("_named", F.lit(3)))))
    best = near.groupBy("poi_id").agg(
        F.min("stage").alias("_stage"), F.max_by("osm_id", F.struct("area", "osm_id")).alias("_largest")
    )
    used = near.join(best, "poi_id").filter(
        (F.col("stage") == F.col("_stage")) & ((F.col("_stage") < 3) | (F.col("osm_id") == F.col("_largest")))
    )
    areas = union_area(used.select("poi_id", "rings"), ["poi_id"], "rings", "footprint_area")
    kinds = used.groupBy("poi_id").agg(F.min("_stage").alias("_stage"), F.count(F.lit(1)).alias("n_polygons"))
    many = F.when(F.col("n_polygons") > 1, "union").otherwise("single")
    kind = (
        F.when(F.col("_stage") == 1, F.concat(F.lit("pip_"), many))
        .when(F.col("_stage") == 2, F.concat(F.lit("name_match_"), many))
        .when(F.col("_stage") == 3, "largest_polygon").otherwise("no_match")
    )
    return (
        places.join(kinds, "poi_id", "left").join(areas, "poi_id", "left")
        .select(*places.columns, F.coalesce("footprint_area", F.lit(0.0)).alias("footprint_area"),
                F.coalesce("n_polygons", F.lit(0)).alias("n_polygons"), kind.alias("match_type"))
    )


def candidate_list(places: DataFrame, key: str, x: str, y: str, features: DataFrame, feature_id: str,
                   rings: str, radius: float = 100.0, k: int = 30) -> DataFrame:
    """The ``k`` nearest features of each place, nearer first, then larger: a review list."""
    near = within_distance(places, x, y, features, rings, radius).withColumn("area", geo.polygon_area(F.col(rings)))
    by = Window.partitionBy(key).orderBy(F.asc("dist"), F.desc("area"), F.asc(feature_id))
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def points_along(edges: DataFrame, key: str, line: str, spacing: float, min_length: float = 5.0) -> DataFrame:
    """Points every ``spacing`` metres from the start of each line; short lines skipped.

    Each segment emits its own share of the positions, so a long line costs no nested scan.
    """
    segs = edges.select(key, F.posexplode(geo.segments(F.col(line))).alias("_i", "_s"))
    length = F.hypot(F.col("_s.x1") - F.col("_s.x0"), F.col("_s.y1") - F.col("_s.y0"))
    along = Window.partitionBy(key).orderBy("_i")
    segs = (
        segs.withColumn("_len", length)
        .withColumn("_end", F.sum("_len").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_whole", F.sum("_len").over(Window.partitionBy(key)))
        .withColumn("_start", F.col("_end") - F.col("_len"))
        .filter((F.col("_whole") >= min_length) & (F.col("_len") > 0))
    )
    first, last = F.ceil(F.col("_start") / spacing), F.ceil(F.col("_end") / spacing) - 1
    steps = segs.filter(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    part = (F.col("step") * spacing - F.col("_start")) / F.col("_len")
    return steps.select(
        key, "step",
        (F.col("_s.x0") + part * (F.col("_s.x1") - F.col("_s.x0"))).alias("x"),
        (F.col("_s.y0") + part * (F.col("_s.y1") - F.col("_s.y0"))).alias("y"),
    )


def ring_points(df: DataFrame, x: str, y: str, radii: Sequence[float] = K.RING_RADII_M,
                per_ring: int = K.RING_POINTS) -> DataFrame:
    """Points on concentric circles around each row: adds radius, step, px, py."""
    angle = F.radians(F.lit(360.0 / per_ring) * F.col("step"))
    return (
        df.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(per_ring - 1))))
        .withColumn("px", F.col(x) + F.col("radius") * F.cos(angle))
        .withColumn("py", F.col(y) + F.col("radius") * F.sin(angle))
    )


def with_sampling_plan(df: DataFrame, subtype: str, plan: Mapping = K.SAMPLING_PLAN) -> DataFrame:
    """Add buffer, spacing and source of each row's subtype; subtypes without a plan go."""
    names = list(plan)
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.trim(F.col(subtype))))
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("buffer_m"), F.lit(float(s)).alias("spacing_m"), F.lit(src).alias("source"))
        for b, s, src in plan.values()
    ])
    picked = F.when(index > 0, F.element_at(rows, F.greatest(index, F.lit(1)).cast("int")))
    return df.withColumn("_plan", picked).filter(F.col("_plan").isNotNull()).select(*df.columns, "_plan.*")


def target_heading(subtype: Column, lat: Column, lon: Column, target_lat: Column, target_lon: Column,
                   landmarks: Sequence[str] = K.LANDMARK_SUBTYPES) -> Column:
    """Bearing to the place for landmark points, NULL otherwise."""
    return F.when(subtype.isin(list(landmarks)), geo.bearing(lat, lon, target_lat, target_lon))


def square_grid(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """Distinct square cells holding the points of ``df``: (gx, gy, rings)."""
    cells = df.select(F.floor(F.col(x) / side).cast("bigint").alias("gx"), F.floor(F.col(y) / side).cast("bigint").alias("gy")).distinct()
    ring = geo.box_ring(F.col("gx") * side, F.col("gy") * side, (F.col("gx") + 1) * side, (F.col("gy") + 1) * side)
    return cells.withColumn("rings", F.array(ring))



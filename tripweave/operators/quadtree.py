"""Adaptive quadtree cover of polygons for joins with points.

Cells are squares of a power of two, aligned at zero, so a point's cell is exact. Cells are
split while they hold much work (points times shapes), two levels at a time. A polygon goes
down the tree once, without a shuffle, and loses ring pieces on the way: a leaf keeps only those
that can still cross a point's ray or lie within reach, and a leaf that no ring reaches keeps
none, only whether it is inside. Each point is looked up once and meets the polygons of its leaf;
a leaf with more than ``LEAF_POINTS`` points is dealt over several keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.session import cut_lineage

#: Points of one key of the join.
LEAF_POINTS = 100_000
#: A cell is split while its points times its shapes (by the middles of their boxes) exceed this.
LEAF_WORK = 1 << 20
#: Bound of the tree, which is broadcast: the work allowed in a leaf is doubled until the tree fits.
MOST_NODES = 1 << 16
#: Levels of one split, of one round of counting, and of the whole tree.
STEP, ROUND, DEPTH = 2, 12, 36

CELL = ["_level", "_cx", "_cy"]


def _cell(v: Column, level) -> Column:
    size = 2.0 ** level if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(v / size).cast("bigint")


def _finite(v: Column) -> Column:
    return F.abs(v) < float("inf")  # false for NULL, and for NaN, which Spark orders last


def _rolled(fine: DataFrame, top: int, low: int) -> DataFrame:
    """Counts of the cells of levels ``top`` to ``low`` from counts of the lowest."""
    levels = F.array(*[F.lit(k) for k in range(top, low - 1, -STEP)])
    up = fine.withColumn("_level", F.explode(levels)).withColumn("_by", F.pow(F.lit(2.0), F.col("_level") - low))
    up = up.withColumn("_cx", F.floor(F.col("_cx") / F.col("_by")).cast("bigint")).withColumn("_cy", F.floor(F.col("_cy") / F.col("_by")).cast("bigint"))
    sums = up.groupBy(*CELL).agg(F.sum("_points").alias("_points"), F.sum("_shapes").alias("_shapes"))
    return sums.withColumn("_work", F.col("_points") * (F.col("_shapes") + 1))


def _parent(df: DataFrame) -> DataFrame:
    by = 2.0 ** STEP
    return df.withColumn("_level", F.col("_level") + STEP).withColumn("_cx", F.floor(F.col("_cx") / by).cast("bigint")).withColumn(
        "_cy", F.floor(F.col("_cy") / by).cast("bigint")
    )


def tree(spots: DataFrame, root: int) -> tuple[DataFrame, list[int]]:
    """Nodes of the tree over ``spots`` (_x, _y, _points, _shapes) and the levels that it has, the root's first.

    Nodes are (_level, _cx, _cy, _leaf, _salts); a cell without points is no node. Points are counted once
    per cell ``ROUND`` levels below the root; only those of cells that are still crowded there are counted
    again, further down. ``_salts`` is the number of keys of a leaf.
    """
    most, nodes, levels, top, open_cells = LEAF_WORK, None, [], root, None
    while True:
        low = top - ROUND
        here = spots if open_cells is None else spots.withColumn("_cx", _cell(F.col("_x"), top)).withColumn("_cy", _cell(F.col("_y"), top)).join(
            F.broadcast(open_cells.select("_cx", "_cy")), ["_cx", "_cy"], "left_semi"
        )
        fine = here.groupBy(_cell(F.col("_x"), low).alias("_cx"), _cell(F.col("_y"), low).alias("_cy")).agg(
            F.sum("_points").alias("_points"), F.sum("_shapes").alias("_shapes")
        )
        counts = cut_lineage(_rolled(fine, top, low))
        sizes = counts.groupBy("_level", F.ceil(F.log2(F.greatest("_work", F.lit(1)))).cast("int").alias("_bits")).count().collect()  # under 64 a level
        # cells that the round before left open are split in any case; it has counted their children
        again = nodes is not None
        room = MOST_NODES // 4 if again else MOST_NODES
        while sum(4 ** STEP * r["count"] for r in sizes if 2 ** r["_bits"] > most and not (again and r["_level"] == top)) > room:
            most *= 2
        crowded = F.col("_work") > most
        split = counts.filter(crowded & (F.col("_level") > low) | F.lit(again) & (F.col("_level") == top)).select(*CELL)
        child = _parent(counts.filter(F.col("_level") < top).withColumn("_own", F.struct(*CELL))).join(F.broadcast(split), CELL)
        child = child.select("_own.*", "_points", "_work")
        if not again:
            child = counts.filter(F.col("_level") == top).select(*CELL, "_points", "_work").unionByName(child)
        # only the lowest level of a round may stay crowded; it is opened by the next
        deeper = root - low < DEPTH and any(r["_level"] == low and 2 ** r["_bits"] > most for r in sizes)
        leaf = ~crowded if deeper else ~crowded | (F.col("_level") == low)
        found = child.select(*CELL, leaf.alias("_leaf"), F.ceil(F.col("_points") / LEAF_POINTS).cast("int").alias("_salts")).filter("_salts > 0")
        nodes = nodes.unionByName(found) if again else found
        opened = {r["_level"] - STEP for r in sizes if 2 ** r["_bits"] > most and r["_level"] > low}
        levels += sorted(opened | ({top - STEP} if again else {top}), reverse=True)
        if not deeper:
            break
        open_cells, top = cut_lineage(child.filter(crowded & (F.col("_level") == low)).select(*CELL), compact=True), low
    return nodes, levels


#: A ring piece ``s`` against the row's cell (``_c``) grown by ``{pad}``: it crosses every ray of the cell from
#: far to the right; it lies level with the cell or right of it; given that, its box meets the grown cell.
ALWAYS = "(least(s.x0, s.x1) > 2 * _c.x1 - _c.x0 + {pad} and least(s.y0, s.y1) <= _c.y0 and greatest(s.y0, s.y1) > _c.y1)"
LEVEL_WITH = (
    "(greatest(s.y0, s.y1) >= _c.y0 - {pad} and least(s.y0, s.y1) <= _c.y1 + {pad} and greatest(s.x0, s.x1) >= _c.x0 - {pad})"
)
MEETS = "least(s.x0, s.x1) <= _c.x1 + {pad}"


def _trim(df: DataFrame, pad: float) -> DataFrame:
    """Drop ring pieces that cannot matter in the row's cell, and settle cells that no ring reaches.

    ``_live`` is false where the polygon does not reach the cell. ``_segs`` keeps the pieces beside or right of the cell at its heights, and those within ``pad``.
    Pieces far right that cross every ray of the cell go into the parity ``_flip`` instead.
    """
    always, level_with, meets = (t.format(pad=f"{pad!r}D") for t in (ALWAYS, LEVEL_WITH, MEETS))
    d = df.withColumn("_c", F.expr(
        "named_struct('x0', _cx * power(2D, _level), 'y0', _cy * power(2D, _level),"
        " 'x1', (_cx + 1) * power(2D, _level), 'y1', (_cy + 1) * power(2D, _level))"
    ))
    d = d.withColumns({
        "_flip": F.expr(f"_flip <> (size(filter(_segs, s -> {always})) % 2 = 1)"),
        "_segs": F.expr(f"filter(_segs, s -> {level_with} and not {always})"),
    }).withColumn("_near", F.expr(f"exists(_segs, s -> {meets})"))
    d = d.withColumns({
        "_flip": F.when(F.col("_near"), F.col("_flip")).otherwise(inside("(_c.x0 + _c.x1) / 2", "(_c.y0 + _c.y1) / 2")),
        "_segs": F.expr("if(_near, _segs, slice(_segs, 1, 0))"),
    })
    # no filter here: it would be pushed below and compute the arrays twice; the next explode drops the row
    return d.withColumn("_live", F.expr("_near or _flip")).drop("_c", "_near")


def inside(x: str, y: str) -> Column:
    """Even-odd test of a leaf's ``_segs`` and ``_flip``, x and y as SQL; a boundary point is outside, as in ``geo.contains``."""
    crosses = f"((s.y0 > {y}) <> (s.y1 > {y})) and {x} < (s.x1 - s.x0) * ({y} - s.y0) / nullif(s.y1 - s.y0, 0D) + s.x0"
    on = (
        f"(s.x1 - s.x0) * ({y} - s.y0) = (s.y1 - s.y0) * ({x} - s.x0)"
        f" and {x} between least(s.x0, s.x1) and greatest(s.x0, s.x1) and {y} between least(s.y0, s.y1) and greatest(s.y0, s.y1)"
    )
    return F.expr(f"((size(filter(_segs, s -> {crosses})) % 2 = 1) <> _flip) and not exists(_segs, s -> {on})")


def cover(shapes: DataFrame, rings: str, nodes: DataFrame, levels: list[int], pad: float) -> DataFrame:
    """Shape rows by leaf: adds the cell, ``_segs``, ``_flip``, ``_box`` and ``_salt``, for leaves within ``pad`` of the shape."""
    tree_side = F.broadcast(nodes)  # MOST_NODES bounds it
    s = shapes.withColumn("_segs", F.flatten(F.transform(F.col(rings), geo.segments))).withColumn("_flip", F.lit(False))
    s = s.withColumn("_box", geo.bounding_box(F.col(rings))).filter(_finite(F.col("_box.x0")) & _finite(F.col("_box.x1")) & _finite(F.col("_box.y0")) & _finite(F.col("_box.y1")))

    def cells(level: int, axis: str) -> Column:
        return F.sequence(_cell(F.col(f"_box.{axis}0") - pad, level), _cell(F.col(f"_box.{axis}1") + pad, level))

    for i, level in enumerate(levels):
        if i == 0:
            s = s.withColumn("_level", F.lit(level)).withColumn("_cx", F.explode(cells(level, "x"))).withColumn("_cy", F.explode(cells(level, "y")))
        else:
            # leaves stay as they are; other nodes open into the children that the shape's box reaches
            fan = 2 ** (levels[i - 1] - level)
            def children(axis: str) -> Column:
                first = F.col(f"_c{axis}") * fan
                a = F.greatest(first, _cell(F.col(f"_box.{axis}0") - pad, level))
                b = F.least(first + fan - 1, _cell(F.col(f"_box.{axis}1") + pad, level))
                opened = F.when(a <= b, F.sequence(a, F.greatest(a, b)))
                return F.explode(F.when(F.col("_live"), F.when(F.col("_leaf"), F.array(f"_c{axis}")).otherwise(opened)))

            s = s.withColumn("_nx", children("x")).withColumn("_ny", children("y"))
            s = s.withColumn("_level", F.when(F.col("_leaf"), F.col("_level")).otherwise(level)).drop("_cx", "_cy", "_leaf", "_salts", "_live")
            s = s.withColumnsRenamed({"_nx": "_cx", "_ny": "_cy"})
        s = _trim(s.join(tree_side, CELL), pad)
    return s.withColumn("_salt", F.explode(F.when(F.col("_live") & F.col("_leaf"), F.sequence(F.lit(0), F.col("_salts") - 1)))).drop("_leaf", "_salts", "_live")


def pairs(points: DataFrame, x: str, y: str, shapes: DataFrame, rings: str, pad: float = 0.0) -> DataFrame:
    """Point rows with the shape rows of their leaf, and the leaf's ``_segs`` and ``_flip``.

    Holds every pair at most ``pad`` apart; the caller decides by ``inside`` or by the distance to ``_segs``,
    which is exact up to ``pad``. Column names of both sides must differ. Points and shapes with NULL,
    NaN or infinite coordinates meet nothing.
    """
    box = shapes.select(geo.bounding_box(F.col(rings)).alias("_b")).select("_b.*")
    box = box.filter(_finite(F.col("x0")) & _finite(F.col("x1")) & _finite(F.col("y0")) & _finite(F.col("y1")))
    frame = box.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    x0, y0, x1, y1 = (0.0, 0.0, 0.0, 0.0) if frame["x0"] is None else (frame["x0"] - pad, frame["y0"] - pad, frame["x1"] + pad, frame["y1"] + pad)
    reach = max(abs(x0), abs(y0), abs(x1), abs(y1), 1e-9)
    root = max(math.ceil(math.log2(max(x1 - x0, y1 - y0, 1e-9))), math.ceil(math.log2(reach)) - 14)
    # a point outside the frame of all shapes meets none
    p = points.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    spots = p.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), one.alias("_points"), none.alias("_shapes")).unionByName(
        box.select(((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"), none.alias("_points"), one.alias("_shapes"))
    )
    nodes, levels = tree(spots, root)
    leaves = cover(shapes, rings, nodes, levels, pad)
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])))
    p = p.withColumn("_cx", _cell(F.col(x), F.col("_level"))).withColumn("_cy", _cell(F.col(y), F.col("_level")))
    p = p.join(F.broadcast(nodes), CELL).filter("_leaf").drop("_leaf")  # the same exchange as in the cover
    p = p.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.col("_salts")).cast("int")).drop("_salts")
    by_x = F.col(x).between(F.col("_box.x0") - pad, F.col("_box.x1") + pad)
    by_y = F.col(y).between(F.col("_box.y0") - pad, F.col("_box.y1") + pad)
    return p.join(leaves, [*CELL, "_salt"]).filter(by_x & by_y).drop(*CELL, "_salt", "_box")

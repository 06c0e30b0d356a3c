"""Spatial de-duplication: connected components of points within ``eps`` per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.session import cut_lineage

FINE = 8  # each cell keeps the boxes of its points in FINE x FINE parts
BLOCK = 512
WINDOW = ["ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1"]


def _box_gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible distance of every box in ``a`` to every box in ``b``."""
    a, b = a[:, None, :], b[None, :, :]
    near_x = np.maximum(0, np.maximum(a[..., 0] - b[..., 2], b[..., 0] - a[..., 2]))
    near_y = np.maximum(0, np.maximum(a[..., 1] - b[..., 3], b[..., 1] - a[..., 3]))
    far_x = np.maximum(np.abs(a[..., 2] - b[..., 0]), np.abs(b[..., 2] - a[..., 0]))
    far_y = np.maximum(np.abs(a[..., 3] - b[..., 1]), np.abs(b[..., 3] - a[..., 1]))
    return np.hypot(near_x, near_y), np.hypot(far_x, far_y)


def _judge_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """1 linked, 0 apart, -1 undecided from the part boxes of two cells.

    Also gives each cell's box grown by ``eps``: only the other cell's points inside it matter.
    """
    for batch in batches:
        verdicts, windows = [], []
        for boxes_a, boxes_b, eps in zip(batch["a_boxes"], batch["b_boxes"], batch["eps"]):
            a = np.array([[p["x0"], p["y0"], p["x1"], p["y1"]] for p in boxes_a], dtype=float)
            b = np.array([[p["x0"], p["y0"], p["x1"], p["y1"]] for p in boxes_b], dtype=float)
            near, far = _box_gaps(a, b)
            verdicts.append(1 if (far <= eps).any() else 0 if (near > eps).all() else -1)
            windows.append([f(p[:, i]) + d for p in (a, b) for f, i, d in ((np.min, 0, -eps), (np.min, 1, -eps), (np.max, 2, eps), (np.max, 3, eps))])
        frame = pd.DataFrame(windows, columns=WINDOW)
        frame.insert(0, "verdict", verdicts)
        for i, c in enumerate(("a", "b", "eps")):
            frame.insert(i, c, batch[c].to_numpy())
        yield frame


def _blocks_touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        linked = []
        for row in batch.itertuples(index=False):
            ax, ay, bx, by = (np.asarray(v, dtype=float) for v in (row.ax, row.ay, row.bx, row.by))
            linked.append(bool((np.hypot(ax[:, None] - bx, ay[:, None] - by) <= row.eps).any()))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node id of each node's component: (node, component), for nodes with edges.

    Alternating large-star and small-star rounds shrink every path to a star in
    logarithmic time. Each round is two grouped minima; its edges are written to the shared
    folder, so lineage stays short.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    links = cut_lineage(links, compact=True)
    mark = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        links = cut_lineage(small.filter("u <> v").distinct(), compact=True)
        row = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def cluster_points(df: DataFrame, group: Sequence[str], x: str, y: str, eps: str, out: str = "cluster") -> DataFrame:
    """Add the connected component of each point: points within ``eps`` are linked, per group.

    Points sharing a grid cell of diagonal ``eps`` are linked by construction, so work is per
    cell, not per point pair. Neighbouring cells are judged by the boxes of their parts; only
    pairs the boxes cannot settle compare points, block by block, in parallel.
    """
    side = F.col("_eps") / F.lit(np.sqrt(2.0))
    keyed = df.withColumn("_eps", F.col(eps).cast("double")).withColumn("_g", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in group], F.col("_eps").cast("string")))
    keyed = keyed.withColumn("_cx", F.floor(F.col(x) / side).cast("bigint")).withColumn("_cy", F.floor(F.col(y) / side).cast("bigint"))
    keyed = keyed.withColumn("_cell", F.concat_ws("\x1f", "_g", F.col("_cx").cast("string"), F.col("_cy").cast("string")))
    points = keyed.groupBy("_g", "_eps", "_cell", "_cx", "_cy", F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    part = F.lit(FINE) / side
    parts = points.groupBy("_g", "_eps", "_cell", "_cx", "_cy", F.floor(F.col("_x") * part).alias("_px"), F.floor(F.col("_y") * part).alias("_py")).agg(
        F.min("_x").alias("x0"), F.min("_y").alias("y0"), F.max("_x").alias("x1"), F.max("_y").alias("y1"),
        F.count(F.lit(1)).alias("_n"),
    )
    # at most (FINE + 1)^2 boxes per cell
    cells = cut_lineage(
        parts.groupBy("_g", "_eps", "_cell", "_cx", "_cy").agg(
            F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"), F.sum("_n").alias("n_points")
        )
    )
    steps = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if dx > 0 or dy > 0]
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    left = cells.select("_g", F.col("_eps").alias("eps"), F.col("_cell").alias("a"), F.col("boxes").alias("a_boxes"), "_cx", "_cy", ahead.alias("_d"))
    left = left.select("_g", "eps", "a", "a_boxes", (F.col("_cx") + F.col("_d.dx")).alias("_cx"), (F.col("_cy") + F.col("_d.dy")).alias("_cy"))
    right = cells.select("_g", "_cx", "_cy", F.col("_cell").alias("b"), F.col("boxes").alias("b_boxes"))
    pairs = left.join(right, ["_g", "_cx", "_cy"]).select("a", "b", "eps", "a_boxes", "b_boxes")
    judged = cut_lineage(pairs.mapInPandas(
        _judge_pairs, "a string, b string, eps double, verdict int, " + ", ".join(f"{c} double" for c in WINDOW)
    ))
    edges = judged.filter("verdict = 1").select("a", "b")
    open_pairs = judged.filter("verdict = -1")

    sized = points.join(cells.select("_cell", "n_points"), "_cell")
    sized = sized.withColumn("_nb", F.ceil(F.col("n_points") / BLOCK).cast("int")).withColumn(
        "_b", F.pmod(F.xxhash64("_x", "_y"), F.col("_nb")).cast("int")
    )

    def side_blocks(own: str, other: str, *names: str) -> DataFrame:
        near = F.col("_x").between(F.col(f"{other}x0"), F.col(f"{other}x1")) & F.col("_y").between(
            F.col(f"{other}y0"), F.col(f"{other}y1")
        )
        rows = open_pairs.join(sized, F.col(own) == F.col("_cell")).filter(near)
        packed = rows.groupBy("a", "b", "eps", "_b").agg(F.collect_list(F.struct("_x", "_y")).alias("_p"))
        return packed.select("a", "b", "eps", "_b", F.col("_p._x").alias(names[0]), F.col("_p._y").alias(names[1]))

    # each block of ``a`` goes to every block of ``b``: the key names that block, so a dense pair of
    # cells becomes many even tasks
    targets = cells.select(F.col("_cell").alias("b"), F.ceil(F.col("n_points") / BLOCK).cast("int").alias("_blocks"))
    sent = side_blocks("a", "b", "ax", "ay").drop("_b").join(targets, "b")
    sent = sent.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    pair_blocks = sent.join(side_blocks("b", "a", "bx", "by").drop("eps"), ["a", "b", "_b"])
    touching = pair_blocks.mapInPandas(_blocks_touch, "a string, b string, linked boolean").filter("linked").select("a", "b").distinct()
    labels = components(edges.unionByName(touching))
    return (
        keyed.join(labels, F.col("_cell") == F.col("node"), "left")
        .withColumn(out, F.coalesce("component", "_cell"))
        .drop("_eps", "_g", "_cx", "_cy", "_cell", "node", "component")
    )


def representatives(df: DataFrame, cluster: str, x: str, y: str, order: str) -> DataFrame:
    """One row per cluster: the member nearest the mean of its distinct positions."""
    centres = df.select(cluster, x, y).distinct().groupBy(cluster).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    placed = df.join(centres, cluster)
    gap = F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"))
    best = placed.groupBy(cluster).agg(F.min_by(F.struct(*df.columns), F.struct(gap, F.col(order))).alias("_row"))
    return best.select("_row.*")


def dedup_summary(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts before and after per key, and the share removed."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("count_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("count_after"))
    joined = b.join(a, list(keys), "left").fillna(0, ["count_after"])
    return joined.withColumn("reduction_ratio", 1 - F.col("count_after") / F.col("count_before"))

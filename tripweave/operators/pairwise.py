"""Sums over all other members of a group, without a row per pair.

Each group is cut into blocks by hash, larger ones in larger groups. A task receives two
blocks and adds up the block-by-block distances with NumPy for both at once, so a large group becomes many
tasks of equal size and only partial sums (one per point and block) are shuffled. Points
at the same place with the same heading are merged first and carry a count.
Heading gaps need no pairs: they are sums over ranges of the sorted headings of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.operators.lookup import with_group_stats
from tripweave.session import cut_lineage

BLOCK = 256
#: Points of the largest blocks, and pairs of points that are held at once.
LARGEST, HELD = 2048, 1 << 17
PARTIAL = (
    "grp string, x double, y double, h double, spatial double, spatial_max double, angular double, angular_max double, kernel double"
)


def _gaps(x: np.ndarray, y: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, other: tuple, density: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum, maximum, kernel) by point of distances between two blocks: of the first over the second, and the other way."""
    ox, oy, ow, ou, ov = other
    mine, theirs = np.zeros((3, len(x))), np.zeros((3, len(ox)))
    mine[1], theirs[1] = -np.inf, -np.inf
    span = max(max(a.max(), b.max()) - min(a.min(), b.min()) for a, b in ((x, ox), (y, oy)))
    plain = 1e-100 < span < 1e100  # squares neither vanish nor overflow
    step = max(HELD // len(ox), 1)
    for i in range(0, len(x), step):
        part = slice(i, i + step)
        gap = x[part, None] - ox
        across = y[part, None] - oy
        if plain:
            gap *= gap
            across *= across
            gap += across
            np.sqrt(gap, out=gap)
        else:
            gap = np.hypot(gap, across)
        mine[0, part], mine[1, part] = gap @ ow, gap.max(axis=1)
        theirs[0] += w[part] @ gap
        np.maximum(theirs[1], gap.max(axis=0), out=theirs[1])
        if density:
            near = np.exp(-0.5 * ((u[part, None] - ou) ** 2 + (v[part, None] - ov) ** 2))
            mine[2, part] = near @ ow
            theirs[2] += w[part] @ near
    return mine, theirs


def _turns(h: np.ndarray, oh: np.ndarray, ow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum by heading of the gaps to weighted headings, at most half a turn; 0 where one is not known."""
    known = ~np.isnan(oh)
    order = np.argsort(oh[known])
    s, w = oh[known][order], ow[known][order]
    total, top = np.zeros(len(h)), np.zeros(len(h))
    mine = ~np.isnan(h)
    if not len(s) or not mine.any():
        return total, top
    a = h[mine]
    weight, moment = np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(w * s)])
    cut = [np.zeros(len(a), int), np.searchsorted(s, a - 180), np.searchsorted(s, a), np.searchsorted(s, a + 180, "right"), np.full(len(a), len(s))]
    (w0, w1, w2, w3), (m0, m1, m2, m3) = ([t[q] - t[p] for p, q in zip(cut, cut[1:])] for t in (weight, moment))
    sums = (360 - a) * w0 + m0 + a * w1 - m1 + m2 - a * w2 + (360 + a) * w3 - m3
    # a gap is largest beside the heading half a turn away
    at = np.clip(np.stack([cut[1] - 1, cut[1], cut[3] - 1, cut[3]]), 0, len(s) - 1)
    gap = np.abs(a - s[at])
    largest = np.minimum(gap, 360 - gap).max(axis=0)
    if not known.all():
        largest = np.maximum(largest, 0.0)
    same = (s[0] == s[-1]) & (a == s[0])
    total[mine], top[mine] = np.where(same, 0.0, sums), largest
    return total, top


def _block_sums(density: bool):
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, y, h, u, v, w = (np.asarray(getattr(row, c), dtype=float) for c in ("x", "y", "h", "u", "v", "w"))
                ox, oy, oh, ou, ov, ow = (np.asarray(getattr(row, f"o{c}"), dtype=float) for c in ("x", "y", "h", "u", "v", "w"))
                mine, theirs = _gaps(x, y, w, u, v, (ox, oy, ow, ou, ov), density)
                sides = [(x, y, h, mine, _turns(h, oh, ow))]
                if row.b != row.ob:
                    sides.append((ox, oy, oh, theirs, _turns(oh, h, w)))
                for px, py, ph, gap, turn in sides:
                    out.append(
                        pd.DataFrame(
                            {
                                "grp": row.grp, "x": px, "y": py, "h": ph, "spatial": gap[0], "spatial_max": gap[1],
                                "angular": turn[0], "angular_max": turn[1], "kernel": gap[2],
                            }
                        )
                    )
            if out:
                yield pd.concat(out, ignore_index=True)

    return add_up


def group_pair_sums(df: DataFrame, group: str, x: str, y: str, heading: str, block: int | None = None, density: bool = True) -> DataFrame:
    """Distinct points of each group with their sums over the whole group.

    Columns: group, x, y, heading, ``members`` (rows at this point), ``n`` (rows in the
    group), ``spatial``/``angular`` (sums of distance and heading gap to all members),
    their maxima, and ``density`` (Gaussian kernel density with Scott's factor and the
    group's own covariance; NULL when that is singular, or not asked for). ``block`` is the size of the smallest blocks.
    """
    block = block or BLOCK
    valid = F.when((F.col(heading) >= 0) & ~F.isnan(heading), F.col(heading).cast("double"))

    def known(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    points = (
        df.groupBy(
            F.col(group).cast("string").alias("grp"), known(x).alias("x"), known(y).alias("y"), valid.alias("h"),
        )
        .agg(F.count(F.lit(1)).alias("w"))
    )
    shape = df.groupBy(F.col(group).cast("string").alias("_g")).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"),
        F.count_distinct(F.struct(x, y, heading)).alias("n_points"),
    )
    scott = F.pow(F.col("n"), F.lit(-1 / 3))  # squared factor n^(-1/6)
    points = points.join(shape, F.col("grp") == F.col("_g")).drop("_g")
    det = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    regular = (F.col("n") >= 3) & (F.col("vx") > 0) & (det > 1e-12 * F.col("vx") * F.col("vy"))
    # rows of the inverse Cholesky factor turn the kernel into a plain distance
    lx = F.sqrt(F.col("vx") * scott)
    ly = F.sqrt(det / F.col("vx") * scott)
    slope = F.col("vxy") / F.col("vx")
    points = points.withColumn("u", F.when(regular, F.col("x") / lx).otherwise(0.0)).withColumn(
        "v", F.when(regular, (F.col("y") - slope * F.col("x")) / ly).otherwise(0.0)
    )
    points = points.withColumn("norm", F.when(regular, 2 * np.pi * lx * ly * F.col("n")))
    # with blocks of a few square roots, neither their pairs nor the partial sums grow with the square of the group
    size = F.greatest(F.lit(block), F.least(F.lit(LARGEST), F.ceil(8 * F.sqrt("n_points"))))
    blocks = F.greatest(F.ceil(F.col("n_points") / size), F.lit(1)).cast("int")
    points = points.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("x", "y", "h"), F.col("nb")).cast("int"))

    def packed(prefix: str, *names: str) -> list:
        gathered = F.collect_list(F.struct(*[F.coalesce(c, F.lit(float("nan"))).alias(c) if c == "h" else c for c in names]))
        return [gathered.alias(f"{prefix}pack")]

    names = ("x", "y", "h", "u", "v", "w")
    left = points.groupBy("grp", "b").agg(*packed("", *names))
    right = points.groupBy("grp", F.col("b").alias("ob")).agg(*packed("o", *names))
    # every block meets itself and every block of a smaller number, which is part of the key, so the pairs of
    # a large group spread over as many keys as it has blocks
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("ob"))))
    # a fixed partition count: the blocks are small in bytes but heavy in work, and would
    # otherwise be merged into a few tasks
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(spread, "grp", "b"), right.repartition(spread, "grp", "b")
    pairs = left.join(right, ["grp", "b"]).select(
        "grp", "b", "ob", *[F.col(f"pack.{c}").alias(c) for c in names], *[F.col(f"opack.{c}").alias(f"o{c}") for c in names],
    )
    sums = pairs.mapInPandas(_block_sums(density), PARTIAL).groupBy(*[F.col(c).alias(f"_{c}") for c in ("grp", "x", "y", "h")]).agg(
        F.sum("spatial").alias("spatial"), F.max("spatial_max").alias("spatial_max"),
        F.sum("angular").alias("angular"), F.max("angular_max").alias("angular_max"),
        F.sum("kernel").alias("kernel"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("grp", "x", "y", "h")]
    return points.join(sums, same).select(
        F.col("grp").alias(group), F.col("x").alias(x), F.col("y").alias(y), F.col("h").alias(heading),
        F.col("w").alias("members"), "n", "spatial", "spatial_max", "angular", "angular_max",
        (F.col("kernel") / F.col("norm") if density else F.lit(None).cast("double")).alias("density"),
    )


def image_spread_scores(df: DataFrame, group: str, x: str, y: str, heading: str) -> DataFrame:
    """Diversity and balance scores in [0, 1] per distinct point of a group.

    Diversity mixes mean distance and mean heading gap to the others, each scaled by the
    group's largest, 0.6 / 0.4. Balance falls with local density; fewer than 3 rows give
    1, a degenerate spread falls back to the mean distance.
    """
    p = cut_lineage(group_pair_sums(df, group, x, y, heading))
    p = with_group_stats(
        p, [group], _smax=F.max("spatial_max"), _amax=F.max("angular_max"), _headed=F.max(F.col(heading).isNotNull())
    )
    others = F.col("n") - 1

    def scaled(total: str, top: str):
        return F.when(F.col(top) > 0, F.col(total) / F.col(top)).otherwise(F.col(total))

    mixed = F.when(
        F.col("_headed"), K.PAIR_WEIGHTS["spatial"] * scaled("spatial", "_smax") + K.PAIR_WEIGHTS["angular"] * scaled("angular", "_amax")
    ).otherwise(scaled("spatial", "_smax"))
    p = p.withColumn("_mixed", F.try_divide(mixed, others))
    p = p.withColumn("_thin", 1 / (1 + F.ln(F.col("density") + 1))).withColumn("_mean", F.try_divide("spatial", others))
    p = with_group_stats(
        p, [group], _mmax=F.max("_mixed"), _tmin=F.min("_thin"), _tmax=F.max("_thin"), _dmax=F.max("_mean")
    )
    diversity = (
        F.when(F.col("n") == 1, 1.0)
        .when(F.col("_mmax") > 0, F.col("_mixed") / F.col("_mmax"))
        .otherwise(F.when(F.col("_headed"), 0.0).otherwise(1.0))
    )
    balance = (
        F.when(F.col("n") < 3, 1.0)
        .when(F.col("_thin").isNotNull(),
              F.coalesce(F.try_divide(F.col("_thin") - F.col("_tmin"), F.col("_tmax") - F.col("_tmin")), F.lit(1.0)))
        .when(F.col("_dmax") > 0, F.col("_mean") / F.col("_dmax"))
        .otherwise(1.0)
    )
    return p.select(group, x, y, heading, "members", diversity.alias("diversity"), balance.alias("balance"))

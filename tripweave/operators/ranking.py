"""Keep-first, top-k, quotas, repeatable samples and running ids.

``row_number() <= k`` filters are pushed below the shuffle as a group limit, so a hot key
ships at most k rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.session import cut_lineage
from tripweave.tables import dealt


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in an explicit order, as a map-side aggregate."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def extremes(df: DataFrame, key: str, value: str, tie: str, k: int = 5, min_rows: int = 10) -> DataFrame:
    """Top and bottom ``k`` per key, for keys with at least ``min_rows`` rows.

    Rows are dealt by key and tie, so a task sorts few of them and of a hot key passes on ``min_rows`` (or ``k``) at most;
    as many tell whether a key is large enough.
    """
    rows = dealt(df.filter(F.col(value).isNotNull()), key, tie)
    enough = F.count(F.lit(1)).over(Window.partitionBy(key)) >= min_rows

    def side(name: str, order: Column) -> DataFrame:
        best = top_k(rows, [key], [order, F.asc(tie)], max(k, min_rows)).withColumn("_enough", enough)
        return best.filter(F.col("_enough") & (F.col("rank") <= k)).drop("_enough").withColumn("side", F.lit(name))

    return side("top", F.desc(value)).unionByName(side("bottom", F.asc(value)))


def quota_top_n(df: DataFrame, key: str, score: str, tie: str, limited: Column, n: Column | int,
                share: float, max_n: int) -> DataFrame:
    """Best ``n`` rows per key where the limited class fills at most ``floor(n * share)``
    places, then spare places are back-filled by score.

    ``n`` may vary by row (constant within a key) up to ``max_n``. The best ``max_n`` of
    each class are enough to decide, so at most ``2 * max_n`` rows per key are compared.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    best = [F.desc(score), F.asc(tie)]
    rows = df.withColumn("_limited", F.coalesce(limited, F.lit(False))).withColumn("_n", n)
    rows = top_k(rows, [key, "_limited"], best, max_n, "_place")
    quota = F.floor(F.col("_n") * F.lit(share))
    rows = rows.withColumn("_allowed", ~F.col("_limited") | (F.col("_place") <= quota))
    ranked = top_k(rows, [key], [F.desc("_allowed"), *best], max_n, "_final")
    return ranked.filter(F.col("_final") <= F.col("_n")).drop("_limited", "_n", "_place", "_allowed", "_final")


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of at most ``n`` rows: the smallest hashes of key and seed."""
    mixed = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.orderBy(mixed, F.col(key)).limit(n)


def running_id(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Dense ids 1, 2, ... in the order of distinct ``order`` columns.

    Rows are range-partitioned and written once; only the per-partition counts (one row
    per partition) are summed together.
    """
    parts = df.repartitionByRange(*[F.col(c).asc() for c in order])
    placed = cut_lineage(parts.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + within + F.lit(start - 1))
        .drop("_part", "_before")
    )


def observation_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based index of each distinct key in sorted order, on every row."""
    distinct = df.select(key).distinct()
    return df.join(running_id(distinct, [key], out, start=0), key)

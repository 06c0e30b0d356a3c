"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import running_totals, stored
from tripweave.session import scratch_scope

SHARDS = 40
VNODES = 64
#: The ring is cut into this many slices; virtual nodes sit at the ends of slices.
SLICES = 1 << 16


def ring(shards: Sequence[int], vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(slice, shard) of every virtual node, in ring order; a node owns the slices up to its own."""
    spots: dict[int, int] = {}
    for shard in sorted(shards, reverse=True):  # on a shared slice the lowest shard wins
        for v in range(vnodes):
            spots[int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big") % SLICES] = shard
    return sorted(spots.items())


def slice_starts(sizes: dict[int, int], nodes: Sequence[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """(slice, arc, rows of the arc before the slice) of each slice in use, and the rows of each arc."""
    ends = [p for p, _ in nodes]
    out, counts = [], {}
    last = ends[-1]
    for piece in sorted(sizes, key=lambda x: (x - last - 1) % SLICES):  # clockwise, from the start of arc 0
        arc = bisect.bisect_left(ends, piece) % len(ends)
        out.append((piece, arc, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + sizes[piece]
    return out, counts


def place(counts: dict[int, int], nodes: Sequence[tuple[int, int]], room: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Send the rows of each arc clockwise until all have a shard with room.

    ``counts`` has the rows of arc i (the arc ending at node i). Round after round each arc
    offers what it has left to the next node; nodes take in ring order until their shard is
    full. Gives (arc, from, to, shard, slot): rows with rank ``from`` to ``to - 1`` in the arc
    take slots ``slot`` onwards. Works on counts only, so its size is that of the ring.
    """
    room = dict(room)
    if sum(counts.values()) > sum(room.values()):
        raise ValueError("the shards have too little room")
    left, begun, used, out = dict(counts), {}, {}, []
    at = {arc: arc for arc in counts}
    while left:
        for arc in sorted(left):
            shard = nodes[at[arc]][1]
            take = min(left[arc], room[shard])
            if take:
                lo, slot = begun.get(arc, 0), used.get(shard, 0)
                out.append((arc, lo, lo + take, shard, slot))
                begun[arc], used[shard] = lo + take, slot + take
                room[shard] -= take
                left[arc] -= take
        left = {a: n for a, n in left.items() if n}
        open_nodes = [i for i, (_, s) in enumerate(nodes) if room[s]]
        for arc in left:  # the next node clockwise whose shard has room
            k = bisect.bisect_right(open_nodes, at[arc])
            at[arc] = open_nodes[k % len(open_nodes)]
    return out


def row_room(n: int, shards: Sequence[int], slack: float) -> dict[int, int]:
    """Most rows of each shard: (1 + slack) times the mean, rounded so that the sum is enough."""
    total = max(n, int(n * (1 + slack)))
    base, more = divmod(total, len(shards))
    return {s: base + (i < more) for i, s in enumerate(sorted(shards))}


def assign(docs: DataFrame, shards: Sequence[int] = tuple(range(SHARDS)), vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    A row's place on the ring is a hash of its doc_id and text checksum; it goes to the shard
    of the next virtual node clockwise and, while that shard is full, on to the next. No shard
    takes more than (1 + ``slack``) times the mean: with no slack, row counts differ by one at
    most. More slack moves fewer rows when shards change. ``slot`` numbers a shard's rows from 0.

    Only row counts per ring slice reach the driver, SLICES numbers at most. Null texts have no
    bytes and checksum 0; rows with equal hashes are ordered by doc_id, checksum and size; fully
    equal rows share the places they fill. Extra columns are ignored. An empty table gives an
    empty one.
    """
    return _assigned(docs, [], shards, vnodes, slack)


def _assigned(docs: DataFrame, also: list[str], shards: Sequence[int], vnodes: int, slack: float) -> DataFrame:
    """``assign`` with further columns of ``docs``."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), *also,
    )
    rows = rows.withColumn("_pos", F.xxhash64("doc_id", "text_crc32"))
    rows = stored(rows.withColumn("_slice", F.pmod("_pos", F.lit(SLICES)).cast("int")))
    sizes = {r["_slice"]: r["n"] for r in rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, counts = slice_starts(sizes, nodes)
    steps = place(counts, nodes, row_room(sum(counts.values()), shards, slack))
    start_table = spark.createDataFrame(starts, "_slice int, _arc int, _start long")
    step_table = spark.createDataFrame(steps, "_arc int, _from long, _to long, shard int, _slot long")
    order = [F.col(c) for c in ("_pos", "doc_id", "text_crc32", "size")]
    ranked = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), ["_slice"], order, "_one", "_n").join(F.broadcast(start_table), "_slice")
    ranked = ranked.withColumn("_rank", F.col("_n") + F.col("_start"))
    placed = ranked.join(F.broadcast(step_table), "_arc").filter("_rank >= _from and _rank < _to")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"), *also)


def write_shards(docs: DataFrame, path: str, shards: Sequence[int] = tuple(range(SHARDS)), vnodes: int = VNODES, slack: float = 0.0) -> None:
    """Write every row, with its shard and slot as in ``assign``, to one folder per shard.

    Rows are dealt by (shard, block of 100,000 slots): several even files make a shard. Columns of
    ``docs`` may have any name; its own ``shard`` and ``slot`` are written as ``shard_in`` and ``slot_in``.
    Null ids and texts and repeated rows have places of their own; an empty table writes no shard.
    """
    with scratch_scope(docs.sparkSession):
        rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("tag")))
        placed = _assigned(rows.select("row.doc_id", "row.text", "tag"), ["tag"], shards, vnodes, slack).select("tag", "shard", "slot")
        kept = [F.col("row")[c].alias(f"{c}_in" if c in ("shard", "slot") else c) for c in docs.columns]
        named = rows.join(placed, "tag").select(*kept, "shard", "slot")
        spread = named.repartition("shard", F.floor(F.col("slot") / 100_000))
        spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

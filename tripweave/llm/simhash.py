"""Near-duplicate groups from 64-bit SimHash fingerprints, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import stored
from tripweave.operators.dedup import components

SEED = 42
SHINGLE = 3
SEGMENTS = 5
DISTANCE = 2
#: Buckets up to this many fingerprints are compared pair by pair; larger ones meet at shared neighbours.
BUCKET = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: bit set when over half of the shingle hashes have it. No word: 0."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words) - shingle + 1
    if n < 1:
        if not words:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = hashes[lo : lo + (1 << 15)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document. Null and blank texts get fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _bounds(segments: int) -> list[int]:
    return [i * 64 // segments for i in range(segments + 1)]


def _rotated(x: Column | str, offset: str) -> str:
    return f"(shiftrightunsigned({x}, {offset}) | shiftleft({x}, 64 - {offset}))"


def chain_holds(a: str, b: str, start: str, segments: int, distance: int) -> Column:
    """Pigeonring condition: from segment ``start`` every chain of l consecutive segments (around
    the ring) differs in at most ``l * distance / segments`` bits, up to the whole ring."""
    cuts = _bounds(segments)
    checks = []
    for s in range(segments):
        turned = _rotated(f"({a} ^ {b})", str(cuts[s]))
        held, width = [], 0
        for length in range(1, segments + 1):
            k = (s + length - 1) % segments
            width += cuts[k + 1] - cuts[k]
            mask = "" if width == 64 else f" & {(1 << width) - 1}L"
            held.append(f"bit_count({turned}{mask}) <= {length * distance // segments}")
        checks.append(f"({start} = {s} and {' and '.join(held)})")
    return F.expr(" or ".join(checks))


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect exactly those at
    ``distance`` or fewer differing bits.

    Two such fingerprints share, from some start on the ring of segments, a chain of
    ``ceil(segments / distance) - 1`` equal segments, so fingerprints meet in the bucket of that
    chain. Buckets of at most ``bucket`` members are compared pairwise: the longer chains are
    checked against their budgets, the whole ring last. In a larger bucket (for a distance of at
    most 2) nothing is compared: every member goes to itself and its 64 neighbours at one bit,
    where all members at two bits or fewer meet, and is linked to the smallest there. That is 65
    rows a member, whatever the bucket holds.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    cuts = _bounds(segments)
    length = -(-segments // distance) - 1
    starts = []
    for s in range(segments):
        width = sum(cuts[(s + i) % segments + 1] - cuts[(s + i) % segments] for i in range(length))
        starts.append(F.struct(F.lit(s).alias("start"), F.expr(f"{_rotated('fp', str(cuts[s]))} & {(1 << width) - 1}L").alias("chain")))
    keyed = fps.select("fp", F.explode(F.array(*starts)).alias("k")).select("fp", "k.start", "k.chain")
    sizes = keyed.groupBy("start", "chain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keyed.join(sizes, ["start", "chain"]), compact=True)
    lists = met.filter(F.col("n") <= bucket).groupBy("start", "chain").agg(F.collect_list("fp").alias("fps"))
    pairs = lists.select("start", F.explode("fps").alias("a"), "fps").select(
        "start", "a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b")
    )
    close = pairs.filter(chain_holds("a", "b", "start", segments, distance)).select("a", "b")
    crowd = met.filter(F.col("n") > bucket).select("fp").distinct()
    spots = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    if distance == 1:  # neighbours at one bit share the smaller as a spot only if it is a member
        around = crowd.select("fp", F.explode(spots).alias("spot"))
        near = around.join(crowd.select(F.col("fp").alias("spot")), "spot").select(F.col("fp").alias("a"), F.col("spot").alias("b"))
        return close.unionByName(near.filter("a < b")).distinct()
    at = crowd.select("fp", F.explode(spots).alias("spot")).groupBy("spot").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    near = at.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return close.unionByName(near).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): group of each document under links of ``distance`` bits or fewer.

    ``component_id`` is the smallest doc_id of the group. Null and blank texts share fingerprint 0.
    A null doc_id is kept and takes part, but names no group: a group without any other id gets
    null. Repeated rows stay repeated. Extra columns are ignored. An empty table gives an empty one.
    """
    rows = stored(with_fingerprints(docs))
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), compact=True)
    parts = components(links(fps.select("fp"), distance, segments, bucket))
    named = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = stored(named, compact=True)
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = named.join(roots, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


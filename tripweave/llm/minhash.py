"""Near duplicates by MinHash: one permutation, optimal densification, bands, star-shaped candidates.

One hash orders the shingles of a set. The order is cut into BANDS x ROWS bins, and each bin keeps
its smallest hash. An empty bin takes the value of the first bin with one in a random order of its
own, so every bin is a fair and independent draw. Sets with equal bins in some band meet in
its bucket. A bucket gives candidates with its smallest member only; what those leave apart is compared
on the full sets, block by block, and gives at most one link for each group that it joins. Every link
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import HASH_SEED as SEED
from tripweave.llm.common import SHINGLE, shingles, sift, small_batches, stored
from tripweave.operators.dedup import components
from tripweave.session import release, scratch_scope

#: Least similarity, as a fraction of whole numbers.
ALIKE = (85, 100)
#: Sets at the least similarity share no band with a chance of (1 - 0.85^5)^40, about 10^-10.
BANDS, ROWS = 40, 5
#: Members of a bucket compared in one block, and shingles of such a block (a larger set is a block of its own).
BLOCK, BLOCK_SHINGLES = 256, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Bins:
    """The draws of the empty bins and the hashes of the bands, the same in every task."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.size = bands, rows, bands * rows
        chance = np.random.Generator(np.random.PCG64(SEED))
        self.order = chance.permuted(np.tile(np.arange(self.size), (self.size, 1)), axis=1)

    def signature(self, names: np.ndarray) -> np.ndarray:
        """The value of each bin for a set of sorted distinct hashes; the set is not empty."""
        place = (names >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)
        first = np.append(True, place[1:] != place[:-1])
        values, filled = np.zeros(self.size, np.uint64), np.zeros(self.size, bool)
        at = place[first].astype(np.int64)
        values[at], filled[at] = names[first], True
        if len(at) < self.size:
            empty = np.flatnonzero(~filled)
            order = self.order[empty]
            values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        return values

    def keys(self, values: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band and its bins."""
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * MIX
        for column in values.reshape(self.bands, self.rows).T:
            key = (key ^ column) * MIX
            key ^= key >> np.uint64(29)
        return key


def with_signatures(docs: DataFrame, bins: Bins, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, node, n, keys, and columns ``also``) of each row: the name of its set (null: no words),
    the set's size and its band keys."""
    kept = ["text", "doc_id", *also]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(0):
                found = shingles(text.as_py(), shingle)
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes(), SEED) if len(found) else None)
                keys.append(bins.keys(bins.signature(found)).view(np.int64) if len(found) else None)
            columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, "node", "n", "keys"])

    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *also)
    made = [T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(signed, T.StructType([*rows.schema.fields, *made]))


def sets_of(texts: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, grams): the sorted shingle hashes of each wanted node. Only texts of wanted nodes are
    shuffled, one for each node."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                found = pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["node", "grams"])

    one = sift(texts, "node", wanted).groupBy("node").agg(F.min("text").alias("text")).join(wanted, "node", "left_semi")
    return one.mapInArrow(grams, "node binary, grams array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of set names whose sets have a Jaccard similarity of ``alike`` or more."""
    p, q = alike
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.filter((p + q) * shared >= p * (F.size("ga") + F.size("gb"))).select("a", "b")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets ``x`` with the sets ``y``: products of incidence matrices,
    a few thousand members of the sets at a time, only of those that both sides have."""
    rows = [np.repeat(np.arange(len(s)), [len(g) for g in s]) for s in (x, y)]
    every = [np.concatenate(s) for s in (x, y)]
    common = np.intersect1d(*every)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(common):
        return out
    spots = [np.minimum(np.searchsorted(common, e), len(common) - 1) for e in every]
    held = [common[s] == e for s, e in zip(spots, every)]
    cells = [(r[h], s[h]) for r, s, h in zip(rows, spots, held)]
    for lo in range(0, len(common), 4096):
        sides = []
        for (r, s), size in zip(cells, out.shape):
            part = (s >= lo) & (s < lo + 4096)
            side = np.zeros((size, min(4096, len(common) - lo)), np.float32)
            side[r[part], s[part] - lo] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _across(alike: tuple[int, int]):
    """Links between groups of a block of a bucket and groups of another one, or of itself: confirmed pairs that
    join them, one fewer than the groups joined."""
    p, q = alike

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, groups, sets = [], [], []
                for c in (0, 1):
                    members = batch.column(c)[k].values
                    nodes.append(members.field("node").to_pylist()), groups.append(members.field("root").to_pylist())
                    sets.append([g.values.to_numpy() for g in members.field("grams")])
                sizes = [np.array([len(g) for g in s]) for s in sets]
                alike_ones = (p + q) * _shared(*sets) >= p * (sizes[0][:, None] + sizes[1])
                root = {g: g for side in groups for g in side}
                found = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(alike_ones))):
                    u, v = groups[0][i], groups[1][j]
                    while root[u] != u:
                        root[u] = u = root[root[u]]
                    while root[v] != v:
                        root[v] = v = root[root[v]]
                    if u != v:
                        root[u] = v
                        found.append((nodes[0][i], nodes[1][j]))
                yield pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.binary()) for s in (0, 1)], names=["a", "b"])

    return pairs


def links(
    nodes: DataFrame, texts: DataFrame, alike: tuple[int, int] = ALIKE, shingle: int = SHINGLE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(a, b): confirmed links that join exactly the sets which links of candidates join, directly or through others.

    ``nodes`` has node, n and keys of each distinct set, ``texts`` has node and text. A bucket of m sets gives
    m - 1 candidates first. Buckets whose members stay in different groups are then compared in blocks; a block
    goes to each partner under a key of its own, so a large bucket becomes many tasks.
    """
    p, q = alike
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    often = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), compact=True)
    shared = sift(keyed, "key", often)  # most keys have one set, whose name is not sorted and shuffled for its bucket
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"), F.min(F.struct("node", "n")).alias("hub"))
    buckets = stored(counts.filter("size > 1"), compact=True)
    met = stored(shared.join(buckets, "key"))
    with small_batches(nodes.sparkSession):
        sets = stored(sets_of(texts, met.select("node").distinct(), shingle))
    able = q * F.least("n", "hub.n") >= p * F.greatest("n", "hub.n")
    stars = met.filter("node <> hub.node").filter(able).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = stored(confirmed(stars.distinct(), sets, alike), compact=True)
    groups = stored(components(first), compact=True).withColumnRenamed("node", "_node")
    others = met.filter("size > 2 and node <> hub.node")  # the hub has met all others
    parts = F.greatest(F.ceil(F.col("size") / F.lit(float(block))), F.ceil(F.col("load") / F.lit(float(block_shingles)))).alias("parts")
    rooted = others.join(groups, F.col("node") == F.col("_node"), "left").select("key", parts, "node", F.coalesce("component", "node").alias("root"))
    rooted = stored(rooted)
    release(met)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    member = F.struct("node", "root", "grams").alias("member")
    cell = F.pmod(F.xxhash64("node"), F.col("parts")).alias("cell")
    cells = rooted.join(mixed, "key", "left_semi").join(sets, "node").select("key", "parts", cell, member)
    cells = stored(cells.groupBy("key", "parts", "cell").agg(F.collect_list("member").alias("members")))
    release(rooted)
    sent = cells.select("key", F.col("members").alias("ma"), F.explode(F.expr("sequence(cell, parts - 1)")).alias("cell"))
    blocks = sent.join(cells.select("key", "cell", F.col("members").alias("mb")), ["key", "cell"]).select("ma", "mb")
    with small_batches(nodes.sparkSession):
        second = stored(blocks.mapInArrow(_across(alike), "a binary, b binary").distinct(), compact=True)
    release(cells)
    return first.unionByName(second)


def near_duplicates(
    docs: DataFrame, alike: tuple[int, int] = ALIKE, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document.

    Documents are linked if their sets of word shingles have a Jaccard similarity of ``alike`` or more
    (words as in ``common.shingles``). ``component_id`` is the smallest doc_id of the group, ``kept``
    whether it is the document's own. Null, empty and blank texts have no shingles and are linked with
    nothing. A null doc_id takes part but names a group only if it has no other: then component_id is null
    and its rows are kept. Repeated rows stay repeated. Extra columns are ignored. An empty table
    gives an empty one.
    """
    bins = Bins(bands, rows)
    with scratch_scope(docs.sparkSession):
        with small_batches(docs.sparkSession):
            marked = stored(with_signatures(docs, bins, shingle))
        worded = marked.filter("node is not null")
        firsts = [F.first(c).alias(c) for c in ("n", "keys")]
        sets = stored(worded.groupBy("node").agg(*firsts, F.min("doc_id").alias("first_id")))
        parts = components(links(sets, worded.select("node", "text"), alike, shingle, block)).withColumnRenamed("node", "_node")
        named = sets.join(parts, F.col("node") == F.col("_node"), "left").select("node", "first_id", F.coalesce("component", "node").alias("root"))
        named = stored(named)
        roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        groups = named.join(roots, "root").select(F.col("node").alias("_node"), "component_id")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
        result = marked.select("doc_id", "n", "node").join(groups, F.col("node") == F.col("_node"), "left")
        result = result.select("doc_id", F.col("n").alias("n_shingles"), component)
        return stored(result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), keep=True)

"""Removal of repeated byte strings: suffixes named to a fixed depth, sorted bucket by bucket.

Only equality of the first DEPTH bytes of two suffixes matters, so suffixes are sorted by names
(hashes of those bytes) instead of by the bytes, and a bucket is a range of names. A difference
cover keeps the work small: any two positions have a shift below COVER that takes both to sampled
positions, so suffixes that agree for DEPTH bytes have a sampled position each, within COVER bytes,
whose next DEPTH - COVER + 1 bytes are named alike. The names of the cover sample are ranked first;
a suffix whose cover names are all unique cannot tie and is not sorted at all. Names of all
others are sorted to the full depth, one bucket a task, in packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import free_shuffles, n_parts, stored

DEPTH = 50
#: Residues modulo COVER; every difference modulo COVER is a difference of two of them.
COVER, RESIDUES = 21, (3, 6, 7, 12, 14)
SHORT = DEPTH - COVER + 1
#: Bytes of text of one block, and of the text whose names fall in one bucket.
BLOCK_BYTES, BUCKET_BYTES = 2_000_000, 8_000_000
NO_ID = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20
#: Bytes kept of a name beside its bucket: cover names only choose what is sorted, so a shared one by
#: chance costs a little time; names of the full depth keep all 64 bits.
NARROW, WIDE = 5, 8
EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"


def _table() -> np.ndarray:
    seed = int.from_bytes(hashlib.md5(b"byte values").digest()[:8], "big")
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, dtype=np.uint64)


BYTE_VALUES = _table()


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def names(data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit names of the ``length``-byte strings at every position, or at the positions ``at``
    (sorted). Equal strings have equal names wherever they stand. Works chunk by chunk."""
    total = len(data) - length + 1
    out = np.empty(max(0, total) if at is None else len(at), np.uint64)
    if total <= 0:
        return out
    span = min(CHUNK, total) + length
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(span, BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(span, INVERSE)]), dtype=np.uint64)
    for lo in range(0, total, CHUNK):
        hi = min(lo + CHUNK, total)
        part = data[lo : hi + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        if at is None:
            out[lo:hi] = _mixed((sums[length:] - sums[:-length]) * down[: hi - lo])
        else:
            a, b = np.searchsorted(at, (lo, hi))
            k = at[a:b] - lo
            out[a:b] = _mixed((sums[k + length] - sums[k]) * down[k])
    return out


class Block:
    """Documents of one range of ids: their bytes end to end, ascending by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths = ids, lengths
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        self.order = np.cumsum(new) - 1  # rows of one id are one document here

    def inside(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions whose next ``length`` bytes stay in their document, and the document's number."""
        doc = np.searchsorted(self.ends, at, side="right")
        fits = at + length <= self.ends[doc]
        return at[fits], doc[fits]

    def cover(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the cover sample, their documents and names."""
        n = len(self.data)
        every = np.arange(0, n, COVER, dtype=np.int64)[:, None] + np.array(RESIDUES)
        at, doc = self.inside(every.ravel()[every.ravel() < n], SHORT)
        return at, doc, names(self.data, SHORT, at)


def _bits(total_bytes: int) -> int:
    """Buckets, as a power of two that grows with the corpus."""
    return max(4, int(np.ceil(np.log2(max(1, total_bytes / BUCKET_BYTES)))))


def _pack(values: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of sorted names by their top ``bits``; each as its next ``width`` bytes."""
    edges = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.append(edges, len(values))
    low = (values << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    cells = low.view(np.uint8).reshape(-1, 8)[:, :width]
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, cells[edges[k] : edges[k + 1]].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    cells = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(cells), 8), np.uint8)
    out[:, :width] = cells
    return out.view(np.uint64).ravel()


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _blocks(raw: DataFrame, marked: DataFrame, total: int, block_bytes: int) -> DataFrame:
    """(block, ids, lengths, data): documents dealt by ranges of doc_id, sorted, one row a range,
    their bytes compressed, as they are read three times and shuffled twice more.
    Short documents and whole copies are left out; marks of the copies travel with the texts."""
    parts = max(1, -(-total // block_bytes))
    ids = marked.filter(~F.col("copy") & (F.col("n_bytes") >= DEPTH)).select("doc_id").repartitionByRange(parts, "doc_id")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).collect()  # one row a range
    firsts = sorted(r["first"] for r in found) or [0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(firsts, np.int64)
        for batch in batches:
            part = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(part, 0), pa.int64()), *batch.columns], names=["block", "doc_id", "mark", "text"])

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "mark", "text"))))
        copies = {(i, t) for i, mark, t in rows if mark}
        kept = [(i, t) for i, mark, t in rows if not mark and not (copies and (i, hashlib.md5(t).hexdigest().encode()) in copies)]
        kept.sort()
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": pa.array([[i for i, _ in kept]], pa.list_(pa.int64())),
            "lengths": pa.array([[len(t) for _, t in kept]], pa.list_(pa.int64())), "data": pa.array([pa.Codec("zstd").compress(b"".join(t for _, t in kept), asbytes=True)], pa.binary()),
        })

    texts = raw.filter(F.octet_length("text") >= DEPTH).select("doc_id", F.lit(False).alias("mark"), "text")
    marks = marked.filter("copy").select("doc_id", F.lit(True).alias("mark"), F.col("md5").cast("binary").alias("text"))
    dealt = texts.unionByName(marks).mapInArrow(deal, "block long, doc_id long, mark boolean, text binary")
    return dealt.repartition(max(parts, n_parts(raw.sparkSession)), "block").groupBy("block").applyInArrow(
        build, "block long, ids array<long>, lengths array<long>, data binary"
    )


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, list[list[tuple[int, bytes]]]]]:
    """Number and content of each block, and what the columns of answers hold for it."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2))
            answers = [[(r["bucket"], r["bits"]) for r in (batch.column(k)[i].as_py() or [])] for k in range(4, batch.num_columns)]
            data = pa.Codec("zstd").decompress(batch.column(3)[i].as_buffer(), int(lengths.sum()), asbytes=True)
            yield batch.column(0)[i].as_py(), Block(ids, lengths, data), answers


PAYLOAD = "block long, bucket long, names binary"


def _payload(number: int, values: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    slices = list(_pack(values, bits, width))
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(slices), pa.int64()), pa.array([k for k, _ in slices], pa.int64()), pa.array([x for _, x in slices], pa.binary())],
        names=["block", "bucket", "names"],
    )


def _ranked(payloads: DataFrame, width: int, whose: str) -> DataFrame:
    """Sort one bucket a task and answer each payload with one bit a name: whether it occurs in
    another block ("any") or in an earlier one ("earlier"). Payloads without a set bit get no row."""

    def rank(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        arrays = [_unpack(x.as_py(), width) for x in table.column("names")]
        sizes = np.array([len(a) for a in arrays])
        values, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = np.append(False, ranked[1:] == ranked[:-1])
        first = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        if whose == "any":
            flag = (np.diff(np.append(first, len(ranked))) > 1)[group]
        else:
            block = blocks[owner[order]]
            flag = block > np.minimum.reduceat(block, first)[group]
        flags = np.empty(len(values), bool)
        flags[order] = flag
        cut = np.cumsum(sizes) - sizes
        bits = [np.packbits(flags[a : a + n]).tobytes() if flags[a : a + n].any() else None for a, n in zip(cut, sizes)]
        keep = [i for i, b in enumerate(bits) if b is not None]
        return pa.table({
            "block": pa.array(blocks[keep], pa.int64()), "bucket": table.column("bucket").take(pa.array(keep, pa.int64())).combine_chunks(),
            "bits": pa.array([bits[i] for i in keep], pa.binary()),
        })

    return payloads.groupBy("bucket").applyInArrow(rank, "block long, bucket long, bits binary")


def _answered(answers: DataFrame, name: str) -> DataFrame:
    """One row a block with the bits of its buckets, at most one entry a bucket."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _flags(values: np.ndarray, bits: int, answer: list[tuple[int, bytes]]) -> np.ndarray:
    """Bits of each of the sorted distinct names of a block."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.append(edges, len(values))
    for bucket, data in answer:
        a, b = edges[bucket], edges[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
    return out


def _candidates(block: Block, bits: int, answer: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose suffix may tie with one of another document to the full depth, their
    documents and names: those with a shared cover name within the first COVER bytes."""
    at, doc, name = block.cover()
    rank = np.argsort(name, kind="stable")
    ranked, who = name[rank], block.order[doc[rank]]
    same = np.append(False, ranked[1:] == ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    first = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    shared = _flags(ranked[first], bits, answer)
    if len(first):
        shared |= np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    hit = np.zeros(len(block.data) + 1, np.int32)
    hit[at[rank[shared[group]]] + 1] = 1
    hit = np.cumsum(hit, dtype=np.int32)
    n = len(block.data) - DEPTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    near = np.flatnonzero(hit[COVER : COVER + n] > hit[:n])
    at, doc = block.inside(near, DEPTH)
    return at, doc, names(block.data, DEPTH, at)


def _locally(block: Block, doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the index of each candidate's name, and whether an earlier document of the
    block has it too."""
    rank = np.argsort(name, kind="stable")
    ranked, who = name[rank], block.order[doc[rank]]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    index, later = np.empty(len(name), np.int64), np.zeros(len(name), bool)
    index[rank] = group
    if len(first):
        later[rank] = who > np.minimum.reduceat(who, first)[group]
    return ranked[first], index, later


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every row.

    A byte goes if a DEPTH-byte string that covers it also starts in a document with a smaller
    doc_id; strings are those of the input and never cross documents. ``removed`` lists the
    maximal removed runs as (start, end) byte offsets. Null texts count as empty. Rows without a
    doc_id come after all others and not before each other; rows with the same doc_id do not remove
    each other's bytes. Extra columns are ignored. An empty table gives an empty one.

    Whole copies are settled by their checksums; the rest is cut into blocks by doc_id. Each block
    ranks its cover names, then the names of the suffixes that may tie, bucket by bucket; answers
    come back as one bit a name. A task holds one block or one bucket.
    """
    spark = docs.sparkSession
    raw = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")
    )
    sized = stored(raw.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha")))
    first = sized.filter(F.col("n_bytes") >= DEPTH).groupBy("md5", "n_bytes").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = sized.join(first.drop("n"), ["md5", "n_bytes"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marked = stored(marked.select("doc_id", "n_bytes", "md5", "sha", "copy"), compact=True)
    total = marked.filter(~F.col("copy") & (F.col("n_bytes") >= DEPTH)).agg(F.sum("n_bytes")).first()[0] or 0
    bits = _bits(total)
    blocks = stored(_blocks(raw, marked, total, block_bytes))
    free_shuffles(spark)

    def cover_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in _each_block(batches):
            yield _payload(number, _distinct(block.cover()[2]), bits, NARROW)

    def tie_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, (cover,) in _each_block(batches):
            yield _payload(number, _distinct(_candidates(block, bits, cover)[2]), bits, WIDE)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, (cover, ties) in _each_block(batches):
            at, doc, name = _candidates(block, bits, cover)
            values, index, gone = _locally(block, doc, name)
            if len(values):
                gone |= _flags(values, bits, ties)[index]
            yield _removed(block, at[gone])

    covers = stored(_answered(_ranked(blocks.mapInArrow(cover_names, PAYLOAD), NARROW, "any"), "cover"), compact=True)
    free_shuffles(spark)
    known = blocks.join(covers, "block", "left").select("block", "ids", "lengths", "data", "cover")
    ties = stored(_answered(_ranked(known.mapInArrow(tie_names, PAYLOAD), WIDE, "earlier"), "ties"), compact=True)
    free_shuffles(spark)
    judged = known.join(ties, "block", "left").select("block", "ids", "lengths", "data", "cover", "ties").mapInArrow(results, RESULT)
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    settled = marked.filter(F.col("copy") | (F.col("n_bytes") < DEPTH)).select(
        "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.col("copy").cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(F.col("copy"), whole).otherwise(nothing).alias("removed"),
    )
    return judged.unionByName(settled).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def _removed(block: Block, at: np.ndarray) -> pa.RecordBatch:
    """Result rows of a block whose strings at the positions ``at`` go."""
    gone = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + DEPTH, -1)
    covered = np.cumsum(gone[:-1]) > 0
    counts, spans, digests, runs = [], [], [], []
    for lo, hi in zip(block.starts.tolist(), block.ends.tolist()):
        part = covered[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
        counts.append(int(part.sum()))
        spans.append(len(edge) // 2)
        digests.append(hashlib.sha256(block.data[lo:hi][~part].tobytes()).hexdigest())
        runs.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [pa.array(block.ids, pa.int64()), pa.array(block.lengths, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(runs, run)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

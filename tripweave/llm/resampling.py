"""Importance resampling to a target distribution: hashed word features, Gumbel scores, distributed quickselect.

Counts of feature buckets, of the documents and of the target texts, give an array of gains; a
document's weight is the mean gain of its features. A fixed random draw of its id is added, so the k
highest scores are a sample without replacement. The k-th score is found by quickselect: random pivot
keys, an exact count of the rows on, and between, the pivots, and a narrower range each round. Only
the winners are sorted and ranked.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import running_totals, stored
from tripweave.session import scratch_scope

NGRAM, BUCKETS = 1, 10_000
#: Words that a document needs to be drawn, and the share drawn, as a fraction.
MIN_WORDS, SHARE = 20, (10, 100)
SEED = 2024
#: Gains and draws are whole numbers of this part of a nat.
SCALE = 1000
#: Pivot keys of one round.
PIVOTS = 31
NOT_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
PLAIN = bytes.maketrans(NOT_WORD + bytes(range(65, 91)), b" " * len(NOT_WORD) + bytes(range(97, 123)))
#: What orders rows: best first, ties to the smaller id (null last); rows of one id and score in a fixed order.
KEY = ["s", "bare", "id", "n_words", "n_features", "tag"]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters (lower-cased) and all characters beyond ASCII."""
    return (text or b"").translate(PLAIN).split()


def features(words: list[bytes], ngram: int = NGRAM) -> Counter[bytes]:
    """How often each run of 1 to ``ngram`` words occurs."""
    found = Counter(words)
    for k in range(2, ngram + 1):
        found.update(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return found


class _Places(dict):
    """Bucket of each feature seen by a task; it is emptied when it grows past what memory should hold."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[feature] = place = zlib.crc32(feature) % self.buckets
        return place


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features in each bucket, over all rows of column ``text``. One row a bucket is collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total = _Places(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = features(words_of(text.as_py()), ngram)
                at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's share in the target to that in the source, one added to every bucket; rounded down."""
    all_source, all_target, buckets = int(source.sum()), int(target.sum()), len(source)
    above = (target + 1).astype(float) * float(all_source + buckets)
    below = (source + 1).astype(float) * float(all_target + buckets)
    return np.floor(SCALE * np.log(above / below)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a document's features, rounded down; 0 without any."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(len(gain))
        for batch in batches:
            sizes, numbers, weights = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = features(words, ngram)
                n = np.fromiter(found.values(), np.int64, len(found))
                number = int(n.sum())
                total = int(n @ gain[np.fromiter(map(places.__getitem__, found), np.int64, len(found))])
                sizes.append(len(words)), numbers.append(number), weights.append(total // number if number else 0)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, numbers, weights))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def draw_of(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw fixed by the id, in parts of SCALE, rounded down; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _order() -> list[Column]:
    return [F.col(c) for c in KEY]


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple | None:
    """The k-th smallest of the composite keys KEY (k from 1; None if there are fewer), which are distinct.

    Each round draws the rows whose hash with the round's number is smallest as pivots, counts the
    rows below, on and between them in one aggregate, and keeps the range that holds the k-th row. At
    most ``pivots`` keys and counts reach the driver; no row moves.
    """
    key = F.struct(*KEY)
    low = high = None
    before, around = 0, 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.filter(key > low[1])
        if high is not None:
            inside = inside.filter(key < high[1])
        chance = F.xxhash64(F.lit(seed + around), *KEY)
        drawn = inside.select(key.alias("key"), chance.alias("chance")).orderBy("chance").limit(pivots).collect()
        if not drawn:
            return None
        points = sorted(tuple(r["key"]) for r in drawn)
        values = [F.struct(*[F.lit(v).cast("boolean" if c == "bare" else "long").alias(c) for c, v in zip(KEY, p)]) for p in points]
        place = F.lit(0)
        for v in values:
            place = place + (key >= v).cast("int") + (key > v).cast("int")
        counts = dict(inside.select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())
        for i in range(2 * len(points) + 1):
            n = counts.get(i, 0)
            if before + n >= k:
                break
            before += n
        else:
            return None
        if i % 2:  # on a pivot, which is one row
            return points[i // 2]
        low = (points[i // 2 - 1], values[i // 2 - 1]) if i else low
        high = (points[i // 2], values[i // 2]) if i // 2 < len(points) else high
        around += 1


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS,
    seed: int = SEED, pivots: int = PIVOTS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row per document; ``rank`` (from 1) is that of the drawn ones.

    ``docs`` has doc_id and text, ``target`` has text. Of the N documents with ``min_words`` words or more,
    the N times ``share`` (rounded down) with the highest scores are drawn, ties to the smaller doc_id,
    a null doc_id last. Rows of one id and score are ranked by words and features, then in the order in
    which they were stored. Null, empty and blank texts have no features and weight 0. Repeated rows count
    each. An empty target gives every bucket the same share. Extra columns are ignored. Empty tables give
    an empty one.
    """
    with scratch_scope(docs.sparkSession):
        gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
        score = (F.col("weight") + draw_of(F.col("doc_id"), seed)).alias("score")
        scored = stored(weighed(docs, gain, ngram).select("*", score, F.monotonically_increasing_id().alias("tag")))
        able = scored.filter(F.col("n_words") >= min_words)
        k = able.count() * share[0] // share[1]
        id_or = F.coalesce("doc_id", F.lit(0)).alias("id")
        keys = able.select((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("bare"), id_or, "n_words", "n_features", "tag", "doc_id", "weight", "score")
        last = kth_key(keys, k, pivots, seed) if k else None
        out = ["doc_id", "n_features", "weight", "score"]
        if last is None:
            return stored(scored.select(*out, F.lit(None).cast("long").alias("rank")), keep=True)
        edge = F.struct(*[F.lit(v).cast("boolean" if c == "bare" else "long").alias(c) for c, v in zip(KEY, last)])
        won = keys.filter(F.struct(*KEY) <= edge).withColumn("_one", F.lit(1).cast("long"))
        ranked = running_totals(won, [], _order(), "_one", "_before").select(*out, (F.col("_before") + 1).alias("rank"))
        lost = keys.filter(F.struct(*KEY) > edge).select(out).unionByName(scored.filter(F.col("n_words") < min_words).select(out))
        return stored(ranked.unionByName(lost.withColumn("rank", F.lit(None).cast("long"))), keep=True)

"""Helpers shared by the corpus operators: word rules, stored tables, distributed prefix sums."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.session import cut_lineage

#: A word is a longest run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a shingle of near copies, and the seed of the shingles' hashes.
SHINGLE, HASH_SEED = 5, 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, compact: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe against lost executors.
    ``compact`` keeps the number of files down, for tables far smaller than the corpus; ``keep`` is for
    the one table that a ``scratch_scope`` returns."""
    return cut_lineage(df, compact, keep)


#: Bytes of the rows that go to Python at once in ``small_batches``; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of what is stored inside go to Python ``BATCH_BYTES`` at a time: what a task and its Python worker hold
    of whole texts does not grow with their length. Without it, 10,000 rows or 64 MB go at once."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    for _ in range(2):  # references from Python go first, then what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


#: Bits of the map that ``sift`` sends to all tasks: 2 MB.
SIFT_BITS = 24


def _looked_up(df: DataFrame, keys: str | Sequence[str], wanted: DataFrame, bits: int, how: str) -> DataFrame:
    """``df`` and ``_hit``: whether its ``keys`` may be among those of ``wanted``, by a map that is broadcast."""
    at = F.xxhash64(*([keys] if isinstance(keys, str) else keys)).bitwiseAND(F.lit((1 << bits) - 1))
    found = wanted.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_cell"))
    cells = found.agg(F.bit_or(F.expr("shiftleft(1L, int(_at & 63))")).alias("_bits"))
    marked = df.withColumn("_at", at).join(F.broadcast(cells), F.shiftright(F.col("_at"), 6) == F.col("_cell"), how)
    return marked.select(*df.columns, F.expr("coalesce((shiftright(_bits, int(_at & 63)) & 1L) = 1, false)").alias("_hit"))


def sift(df: DataFrame, keys: str | Sequence[str], wanted: DataFrame, bits: int = SIFT_BITS) -> DataFrame:
    """The rows of ``df`` whose ``keys`` may be among those of ``wanted``, before a join that shuffles.

    All rows with a wanted key stay, and some others; the join decides. The map of ``2**bits``
    hashed keys is broadcast, at most ``2**(bits - 6)`` rows whatever ``wanted`` holds.
    """
    return _looked_up(df, keys, wanted, bits, "inner").filter("_hit").drop("_hit")


def sieve(df: DataFrame, keys: str | Sequence[str], wanted: DataFrame, bits: int = SIFT_BITS) -> tuple[DataFrame, DataFrame]:
    """What ``sift`` leaves, and the other rows of ``df``: none of those has a wanted key."""
    marked = _looked_up(df, keys, wanted, bits, "left")
    return marked.filter("_hit").drop("_hit"), marked.filter("not _hit").drop("_hit")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles; the words themselves, if they are too few for one.
    Of UTF-8 bytes only A-Z are lower-cased and only ASCII white space parts words. No word: an empty set."""
    words = (text or b"").lower().split()
    n = len(words) - shingle + 1
    if n < 1:
        grams = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(HASH_SEED)), np.uint64, n))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id written as decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (a long) over the earlier rows of the group in ``order``.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; each
    range adds the sum of the ranges before it, a table of one row per (range, group). Rows that
    tie in ``order`` follow each other in any order. The result does not depend on where the
    ranges are cut.
    """
    names = list(group)
    ranks = [F.col(g).asc_nulls_last() for g in names] + list(order)
    ranged = stored(df.repartitionByRange(n_parts(df.sparkSession), *ranks).withColumn("_range", F.spark_partition_id()), compact=True)
    sums = ranged.groupBy("_range", *names).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*names).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(names)],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = W.partitionBy("_range", *names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(names):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_start")).cast("long").alias(out))

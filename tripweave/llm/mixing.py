"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import running_totals, stored, word_count
from tripweave.session import scratch_scope

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share``
    times all sizes. A target stops at ``most`` times its source's size and the excess is shared
    again by weight until none is above: target = min(most * size, level * weight) for the one
    level at which the targets add up, found by running sums over the sources in the order in
    which they reach their limits.
    """
    base = sources.select("source", F.col("source_size").cast("long").alias("source_size"), F.lit(1).cast("long").alias("one"))
    ranked = running_totals(base, [], [F.col("source").asc_nulls_last()], "one", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"), "place")
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = [F.col("ratio"), F.col("place")]
    full = running_totals(ranked, [], order, "limit", "limits_before")
    full = stored(running_totals(full, [], order, "weight", "weights_before"), compact=True)
    total = full.agg((F.sum("source_size") * F.lit(float(share))).alias("all_words"), F.sum("weight").alias("all_weights"))
    tried = full.join(F.broadcast(total)).withColumn(
        "level", (F.col("all_words") - F.col("limits_before")) / (F.col("all_weights") - F.col("weights_before"))
    )
    level = tried.filter("ratio >= level").agg(F.min_by("level", F.struct("ratio", "place")).alias("level"))
    limit = F.col("limit").cast("double")
    return full.join(F.broadcast(level)).select(
        "source", "source_size", F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit)).alias("target")
    )


def random_key(doc_id: Column) -> Column:
    """Hash-random key of a document: MD5 of its id, the same in every run."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    Size is the number of words. Within its source each row has a hash-random place; the mix
    takes the source over and over in that order and stops at the exact budget (the target,
    rounded): ``taken`` counts the words it takes of the row, repeats included, and the last
    row of the last epoch may be taken in part. Null texts have no words. Rows without a source
    form a source of their own. Rows without an id, or with the same, follow each other by size.
    Extra columns are ignored. An empty table gives an empty one.
    """
    placed = _placed(stored(_sized(docs)), [], weights, share, most)
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken)


def _sized(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, source, size, _key) of each row, and columns ``also``."""
    number = F.col("doc_id").cast("long")
    return docs.select(
        number.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        random_key(number).alias("_key"), *also,
    )


def _placed(rows: DataFrame, also: list[str], weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Each row of a stored ``_sized`` table with the whole epochs of its source, and the words that the last epoch
    takes of it. ``also`` are further columns, by which rows that tie are ordered last."""
    rows = rows.select("doc_id", "source", "size", "_key", *also)
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), compact=True)
    placed = running_totals(rows, ["source"], [F.col(c) for c in ("_key", "doc_id", "size", *also)], "size", "_before")
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target")
    # as many rows as there are sources; left to the optimizer, which splits a hot source
    joined = placed.join(aims, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return joined.withColumn("epochs", epochs).withColumn("part", part)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, columns as they came.

    A document taken in part at its source's cut comes whole once more. Documents without words
    (null, empty or blank texts) cost nothing and stay once. Every row is judged by itself, whatever
    id it has or shares. Columns may have any name. An empty table gives an empty one.

    A source's rows come once an epoch, and once more up to its cut, so one row a source decides: texts
    are not shuffled. They are stored once, as they came; the copies are made where the result is read.
    """
    with scratch_scope(docs.sparkSession):
        whole = [F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("tag")]
        rows = stored(_sized(docs, *whole), keep=True)
        placed = _placed(rows, ["tag"], weights, share, most)
        place = F.struct("_key", "doc_id", "size", "tag")
        cuts = placed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("part") > 0, place)).alias("cut"))
        cuts = stored(cuts.withColumnRenamed("source", "_source"), compact=True, keep=True)
    judged = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    once_more = F.coalesce(place <= F.col("cut"), F.lit(False)).cast("int")
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + once_more).cast("int")
    copies = judged.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select("row.*")

"""Incremental processing: resume, per-batch logs, replay-safe writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.ranking import keep_first
from tripweave.sources.routes import stream_documents


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def final_dedup(appended: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key of an appended table."""
    return keep_first(appended, keys, order)


def stream_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """The same inside a stream: each key passes once.

    Keys are forgotten ``delay`` after the watermark passed their ``event_time``, so the state is bounded; rows
    that come later than that are dropped. Take the longest time between two copies, or by which files are late.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


OUTCOMES = ("success", "skipped", "error", "exception")


def outcome(s: Column) -> Column:
    """Outcome class of a status; no status is an error."""
    return (
        F.when(s == "OK", "success").when(s.isin("NO_ITINERARY", "NO_ROUTE_SUMMARY"), "skipped")
        .when(s == "BAD_JSON", "exception").otherwise("error")
    )


def outcome_counts(df: DataFrame, status: str, batch: int | None = None) -> DataFrame:
    """Rows per outcome class: success, skipped, error or exception."""
    kind = outcome(F.col(status)).alias("outcome")
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.lit(batch).cast("bigint"))


def run_document_stream(docs: DataFrame, parse: Callable[[DataFrame], DataFrame], status: str, target: str) -> None:
    """Turn a stream of (file, body) into rows, then stop when nothing is left.

    A micro-batch is parsed once, in the job that writes it: clean and error rows part by a partition column,
    and the counts of the log are observed on the way. Each batch overwrites its own ``batch_id`` folder of
    rows and log, so a replayed batch leaves no duplicates. A row without a status is an error.
    Read the rows with ``read_rows``; the log has (outcome, n, batch_id).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        kind = outcome(F.col(status))
        rows = parse(batch).observe(seen, *[F.count_if(kind == o).alias(o) for o in OUTCOMES])
        part = F.when(F.col(status) == "OK", "clean").otherwise("errors")
        rows.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{target}/rows/batch_id={batch_id}")
        log = [(o, seen.get[o]) for o in OUTCOMES if seen.get[o]]
        batch.sparkSession.createDataFrame(log, "outcome string, n bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{target}/log/batch_id={batch_id}"
        )

    query = docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def read_rows(spark: SparkSession, target: str, part: str) -> DataFrame:
    """``clean`` or ``errors`` rows of ``run_document_stream``, with ``batch_id``; only their folders are read."""
    return spark.read.parquet(f"{target}/rows").filter(F.col("part") == part).drop("part")


def run_route_stream(spark: SparkSession, source: str, parse: Callable[[DataFrame], DataFrame], status: str,
                     target: str, max_files: int | None = None) -> None:
    """``run_document_stream`` over the new route files of a folder."""
    docs = stream_documents(spark, source) if max_files is None else _capped(spark, source, max_files)
    run_document_stream(docs, parse, status, target)


def _capped(spark: SparkSession, source: str, max_files: int) -> DataFrame:
    """Stream reading at most ``max_files`` files per batch (a batch size, not a row cap)."""
    raw = (
        spark.readStream.option("recursiveFileLookup", True).option("wholetext", True)
        .option("maxFilesPerTrigger", max_files).text(source)
    )
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("body"))


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table through the exactly-once file sink."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )

"""Session settings, the shared folder, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []
#: With it Spark deletes the shuffle files of a write when the write ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tripweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings this library assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master with nothing set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if base is None:
            if not context.master.startswith(("local[", "local*")) and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            base = tempfile.mkdtemp(prefix="tripweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    for made in _OPEN:
        made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, everything stored inside; results must be written or collected before."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN[:] = [m for m in _OPEN if m is not made]
        for path in made:
            _delete(spark, path)


def cut_lineage(df: DataFrame, compact: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For tables used more than once, and for loops: a lost executor then costs a re-read, and
    the optimizer sees the true size, prunes columns and may broadcast. Shuffle files of the write go
    when it ends. ``compact`` is for tables far smaller than their inputs: at most three files a core,
    however many partitions made them.
    ``keep`` lets the table outlive the innermost ``scratch_scope``, as what the scope returns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    if keep and _OPEN:
        _OPEN[-1].remove(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.coalesce(3 * spark.sparkContext.defaultParallelism) if compact else df).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        path = table._stored_at
        for made in _OPEN:
            if path in made:
                made.remove(path)
        _delete(table.sparkSession, path)

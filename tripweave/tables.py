"""Reading Parquet tables with the null discipline the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (Spark aggregates skip only NULL)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        [
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan ``folder/name.parquet``, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as the session has shuffle partitions; they are not merged again.

    For narrow tables whose rows are multiplied or sorted next: one split of a file may hold millions of them. Up to
    the number of partitions used here Spark writes a shuffle without holding rows in memory.
    """
    conf = df.sparkSession.conf
    many = min(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")))
    return df.repartition(many, *keys)

"""CSV tables: plain, survey exports, fixed separators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.operators.columns import require_columns
from tripweave.tables import nan_to_null


#: Separators tried, and the lines they are tried on: the first of each of the first files.
SEPARATORS = (",", ";", "\t", "|")
SNIFF_FILES, SNIFF_LINES = 8, 200


def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = SEPARATORS) -> str:
    """The separator that cuts most lines into one and the same number of fields; of equals, the most fields.

    Separators inside quotes do not count; lines with an open quote, parts of a longer record, and empty lines
    are left out. Without a line that any candidate cuts, the first candidate. Reads at most ``SNIFF_LINES`` lines of
    ``SNIFF_FILES`` files.
    """
    files = sorted(spark.read.text(path).inputFiles())[:SNIFF_FILES]
    if not files:
        return candidates[0]
    lines = reduce(DataFrame.unionByName, [spark.read.text(unquote(f)).limit(SNIFF_LINES) for f in files])
    bare = F.regexp_replace("value", '"[^"]*"', "")
    lines = lines.select(bare.alias("bare")).filter((F.trim("bare") != "") & ~F.contains("bare", F.lit('"')))
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_count("bare", F.lit("\\" + c)).alias("n")) for i, c in enumerate(candidates)])
    counted = lines.select(F.inline(cuts)).filter("n > 0").groupBy("i", "n").count()
    best = counted.orderBy(F.desc("count"), F.desc("n"), "i").first()
    return candidates[best["i"]] if best else candidates[0]


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             schema: T.StructType | str | None = None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV with a header. Without ``schema`` every column is text; ``columns`` prunes.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path)
    if columns:
        df = require_columns(df, columns).select(*columns)
    return nan_to_null(df)


def read_survey_csv(spark: SparkSession, path: str, id_column: str, id_pattern: str = r"^R_\w+$", sep: str | None = None,
                    multi_line: bool = False) -> DataFrame:
    """Survey export whose second and third lines repeat labels.

    Label rows are told by the id column's content, not by position, so the file may be
    split over tasks or come in many parts. Without ``sep`` the separator is found from the lines.
    """
    df = read_csv(spark, path, sep=sep or sniff_separator(spark, path), multi_line=multi_line)
    return df.filter(F.col(f"`{id_column}`").rlike(id_pattern))


def read_report_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a multi-table report written by ``sinks.write_report``."""
    return spark.read.parquet(f"{base}/{name}")

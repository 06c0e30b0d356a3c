"""Choice-design tables: candidates, prohibitions, checks and assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.reshape import append_all


def factorial(spark: SparkSession, levels: Mapping[str, int]) -> DataFrame:
    """All level combinations: profile number decoded in mixed radix, so no join is needed."""
    total = reduce(lambda a, b: a * b, levels.values(), 1)
    df = spark.range(total).withColumnRenamed("id", "profile")
    step = 1
    for name, n in levels.items():
        df = df.withColumn(name, (F.floor(F.col("profile") / step) % n).cast("int"))
        step *= n
    return df


def drop_prohibited(df: DataFrame, rules: Sequence[Mapping[str, int]]) -> DataFrame:
    """Drop profiles that meet any rule; an attribute a rule leaves out matches anything."""
    for rule in rules:
        hit = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in rule.items()])
        df = df.filter(F.coalesce(~hit, F.lit(True)))
    return df


def level_balance(df: DataFrame, levels: Mapping[str, int]) -> DataFrame:
    """Frequency of each attribute level against the balanced share."""
    long = df.unpivot([], list(levels), "attribute", "level").dropna()
    counts = long.groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("_total"))
    ideal = reduce(
        lambda acc, item: F.when(F.col("attribute") == item[0], F.col("_total") / item[1]).otherwise(acc),
        levels.items(), F.lit(None).cast("double"),
    )
    return counts.join(totals, "attribute").select(
        "attribute", "level", "n", ideal.alias("ideal"), (F.col("n") / F.col("_total")).alias("share")
    )


def dominates(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """True when one side is at least as good on every attribute and better on one."""
    pairs = F.arrays_zip(F.array(*a).alias("p"), F.array(*b).alias("q"))
    up = F.forall(pairs, lambda z: z["p"] >= z["q"]) & F.exists(pairs, lambda z: z["p"] > z["q"])
    down = F.forall(pairs, lambda z: z["q"] >= z["p"]) & F.exists(pairs, lambda z: z["q"] > z["p"])
    return up | down


def assemble(main: DataFrame, validity: DataFrame, repeats: DataFrame, block_map: DataFrame,
             attributes: Sequence[str]) -> DataFrame:
    """Full design: main, validity and repeat sets with opt-out rows and blocks.

    ``main`` and ``validity`` are (choice_set, alt, attributes), ``repeats`` is
    (choice_set, retest_of): a repeat takes the profiles of its source set.
    """
    copied = repeats.join(main.withColumnRenamed("choice_set", "retest_of"), "retest_of")
    parts = [
        main.withColumn("set_type", F.lit("Main")),
        validity.withColumn("set_type", F.lit("Extreme_VC")),
        copied.withColumn("set_type", F.lit("Test_Retest")),
    ]
    profiles = append_all(*parts)
    opt_out = profiles.select("set_type", "choice_set", "retest_of").distinct().withColumn("alt", F.lit("Opt_Out"))
    full = append_all(profiles, opt_out)
    return full.join(block_map, "choice_set", "left").select("block", "set_type", "choice_set", "retest_of", "alt", *attributes)


def block_summary(design: DataFrame, first_alt: str = "Alt1") -> DataFrame:
    """Sets per block by type, as comma-separated lists."""
    rows = design.filter(F.col("alt") == first_alt)

    def listed(kind: str, col: str) -> Column:
        ids = F.array_sort(F.collect_list(F.when(F.col("set_type") == kind, F.col(col).cast("int"))))
        return F.array_join(F.transform(ids, lambda v: v.cast("string")), ", ")

    return rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("total_sets"), listed("Main", "choice_set").alias("main_sets"),
        listed("Extreme_VC", "choice_set").alias("validity_sets"),
        listed("Test_Retest", "choice_set").alias("retest_sets"), listed("Test_Retest", "retest_of").alias("retest_of"),
    )

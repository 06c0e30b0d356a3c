"""Survey answers: blocks, choice tables, ratings and response quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.costs import survey_cost
from tripweave.functions.numeric import level_dummies, pivot_level
from tripweave.functions.text import strict_double

ALTERNATIVES = ("A", "B", "C")
OPT_OUT = "C"
N_TASKS = 8
VALIDITY_TASK = 7
REPEAT_TASK = 8


def first_present(cols: Mapping[int, str]) -> Column:
    """Label of the first column with an answer: the respondent's block."""
    return F.coalesce(
        *[F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", label) for label, c in cols.items()]
    )


def choice_long(people: DataFrame, answers: Mapping[tuple[int, int], str], design: DataFrame,
                offsets: Mapping[int, int] | None = None, person: str = "person_id",
                keep: Sequence[str] = ()) -> DataFrame:
    """Wide answers to one row per person, task and alternative.

    ``answers`` maps (block, task) to the answer column, coded 1/2/3 after subtracting the
    block's offset. ``design`` is (block, task, alt, scale_j, tt_level, cost_level,
    transfer_level, ...); the repeat task takes the design of its source task. ``people``
    carries the baselines car_time, car_cost, pt_time, pt_cost. Unanswered tasks are
    dropped. A narrow explode and one join with the design.
    """
    offsets = {1: K.FIRST_BLOCK_OFFSET} if offsets is None else offsets
    blocks = sorted({b for b, _ in answers})
    rows = people.withColumn("block", first_present({b: answers[(b, 1)] for b in blocks})).filter(F.col("block").isNotNull())
    by_block = None
    for b in blocks:
        cells = F.array(*[
            strict_double(F.col(f"`{answers[(b, t)]}`").cast("string")) if (b, t) in answers else F.lit(None).cast("double")
            for t in range(1, N_TASKS + 1)
        ])
        by_block = F.when(F.col("block") == b, cells) if by_block is None else by_block.when(F.col("block") == b, cells)
    base = ["car_time", "car_cost", "pt_time", "pt_cost"]
    rows = rows.select(person, "block", *[F.col(c).alias(f"_{c}") for c in base], *keep, F.posexplode(by_block).alias("_t", "_raw"))
    shift = F.lit(0)
    for b, s in offsets.items():
        shift = F.when(F.col("block") == b, s).otherwise(shift)
    code = (F.col("_raw") - shift).cast("int")
    rows = rows.withColumn("task", F.col("_t") + 1).withColumn(
        "_choice", F.try_element_at(F.array(*[F.lit(a) for a in ALTERNATIVES]), F.when(code.between(1, 3), code))
    ).filter(F.col("_choice").isNotNull())
    rows = rows.withColumn("alt", F.explode(F.array(*[F.lit(a) for a in ALTERNATIVES])))
    rows = rows.withColumn("_design_task", F.when(F.col("task") == REPEAT_TASK, K.RETEST_TASK).otherwise(F.col("task")))
    levels = design.select(
        F.col("block").alias("_b"), F.col("task").alias("_dt"), F.col("alt").alias("_a"),
        "scale_j", "tt_level", "cost_level", "transfer_level",
    )
    rows = rows.join(
        levels, (F.col("block") == F.col("_b")) & (F.col("_design_task") == F.col("_dt")) & (F.col("alt") == F.col("_a")), "left"
    )
    out_of = F.col("alt") == OPT_OUT
    deltas = K.LEVEL_DELTAS

    def shifted(name: str, baseline: Column, level: str) -> Column:
        return F.when(out_of, 0.0).otherwise(pivot_level(baseline, F.col(level), deltas[name])).alias(name)

    kind = F.when(F.col("task") == VALIDITY_TASK, "Extreme_VC").when(F.col("task") == REPEAT_TASK, "Test_Retest").otherwise("Standard")
    scale = F.when(out_of, 0).otherwise(F.coalesce("scale_j", F.lit(0))).cast("int")
    shaped = rows.select(
        person, "block", "task", kind.alias("task_type"), "alt",
        F.array_position(F.array(*[F.lit(a) for a in ALTERNATIVES]), F.col("alt")).cast("int").alias("_pos"),
        F.when(F.col("alt") == F.col("_choice"), 1).otherwise(0).alias("chosen"),
        shifted("car_time", F.col("_car_time"), "tt_level"), shifted("car_cost", F.col("_car_cost"), "cost_level"),
        shifted("pt_time", F.col("_pt_time"), "tt_level"), shifted("pt_cost", F.col("_pt_cost"), "cost_level"),
        shifted("pt_transfer", F.lit(1.0), "transfer_level"), scale.alias("scale_j"), *keep,
    )
    dummies = level_dummies(F.col("scale_j"))
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("car_time", "pt_time", "car_cost", "pt_cost", "pt_transfer")]
    return (
        shaped.withColumn("alt_num", F.col("_pos") - 1).drop("_pos")
        .withColumns(dummies)
        .withColumn("gtc", survey_cost(*filled, F.col("alt") == OPT_OUT))
        .withColumn("obs_id", F.concat_ws("_", F.col(person).cast("string"), F.col("block").cast("string"), F.col("task").cast("string")))
    )


def response_quality(long: DataFrame, person: str = "person_id") -> DataFrame:
    """Validity pass and repeat agreement per person, with the screening verdict."""
    picked = F.when(F.col("chosen") == 1, F.col("alt"))

    def choice(task: int) -> Column:
        return F.max(F.when(F.col("task") == task, picked))

    per = long.groupBy(person, "block").agg(
        choice(VALIDITY_TASK).alias("vc_choice"), choice(K.RETEST_TASK).alias("source_choice"),
        choice(REPEAT_TASK).alias("retest_choice"),
    )
    passed = F.coalesce(F.col("vc_choice") == "A", F.lit(False)).cast("int")
    same = F.coalesce(F.col("source_choice") == F.col("retest_choice"), F.lit(False)).cast("int")
    return per.withColumn("vc_pass", passed).withColumn("retest_match", same).withColumn(
        "verdict",
        F.when((passed == 0) & (same == 0), "remove").when((passed == 0) | (same == 0), "flag").otherwise("keep"),
    )


def pass_rates(quality: DataFrame) -> DataFrame:
    """Persons, passes and rates of both checks of ``response_quality``, and the number of each verdict: one row.
    Rates of no persons are NULL."""
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return quality.agg(
        F.count(F.lit(1)).alias("n"), count("vc_pass").alias("vc_passed"), F.avg("vc_pass").alias("vc_rate"),
        count("retest_match").alias("retest_matched"), F.avg("retest_match").alias("retest_rate"),
        *[count(f"verdict = '{v}'").alias(f"n_{v}") for v in ("keep", "flag", "remove")],
    )


def passers(quality: DataFrame, person: str = "person_id") -> DataFrame:
    """Ids of the persons who passed the validity task in every block that they answered."""
    return quality.groupBy(person).agg(F.min("vc_pass").alias("_all")).filter("_all = 1").select(person)


def choice_shares(long: DataFrame, alt: str = "alt") -> DataFrame:
    """Chosen count and share per alternative."""
    chosen = long.filter(F.col("chosen") == 1).groupBy(alt).agg(F.count(F.lit(1)).alias("n"))
    total = chosen.agg(F.sum("n").alias("_total"))
    return chosen.crossJoin(F.broadcast(total)).select(alt, "n", (F.col("n") / F.col("_total")).alias("share"))


def bad_observations(long: DataFrame, obs: str, alt: str = "alt_num") -> DataFrame:
    """Observations without exactly one choice among at least two alternatives."""
    per = long.groupBy(obs).agg(F.count_distinct(alt).alias("n_alts"), F.sum("chosen").alias("n_chosen"))
    return per.filter((F.col("n_alts") < 2) | (F.col("n_chosen") != 1))


def straight_liners(ratings: DataFrame, person: str, value: str, n_cells: int) -> DataFrame:
    """Persons who filled every cell with one single value."""
    per = ratings.groupBy(person).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return per.filter((F.col("_n") == n_cells) & (F.col("_lo") == F.col("_hi"))).select(person)


def rating_missing(ratings: DataFrame, image: str, dim: str, value: str) -> DataFrame:
    """Valid count and missing percentage per image and dimension."""
    return ratings.groupBy(image, dim).agg(
        F.count(value).alias("n_valid"), F.bround(F.avg(F.col(value).isNull().cast("double")) * 100, 1).alias("missing_pct")
    )

"""Survey answers to respondent tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.numeric import code_map, flag_in, reverse_score
from tripweave.functions.text import strict_double
from tripweave.operators.filters import screen
from tripweave.operators.psychometrics import subscale_means
from tripweave.operators.ranking import running_id
from tripweave.operators.scaling import z_scores


def screen_respondents(raw: DataFrame, finished: str, duration: str, attention: str) -> tuple[DataFrame, DataFrame]:
    """Finished, slow enough, attentive; with the attrition table."""
    def num(c: str):
        return strict_double(F.col(f"`{c}`").cast("string"))

    return screen(raw, {
        "finished": num(finished) == 1, "duration": num(duration) > K.MIN_DURATION_SEC,
        "attention": num(attention) == K.ATTENTION_VALUE,
    })


def number_respondents(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Person ids 1, 2, ... in the order of a unique response key."""
    return running_id(df, order, "person_id")


def recode(df: DataFrame) -> DataFrame:
    """Age and income midpoints, car access, work-from-home flag and days."""
    def num(c: str):
        return strict_double(F.col(c).cast("string"))

    wfh = flag_in(num("work_arrangement"), [2, 3])
    return df.withColumns({
        "age_num": code_map(num("age_band").cast("int"), K.AGE_CODE_MIDPOINTS).cast("double"),
        "income_num": code_map(num("income_band").cast("int"), K.INCOME_CODE_MIDPOINTS).cast("double"),
        "car_avail": flag_in(num("car_access"), [1, 2]),
        "is_wfh": wfh,
        "wfh_days_num": F.when(wfh == 1, F.coalesce(F.greatest(num("wfh_days") - 1, F.lit(0.0)), F.lit(0.0))).otherwise(0.0),
        "hh_size": num("household_size"),
    })


def attitudes(df: DataFrame, scales: Mapping[str, Sequence[str]], reverse: Sequence[str] = (), scale_max: int = 5) -> DataFrame:
    """Subscale means (reversed items turned first) and their z-scores."""
    items = [i for s in scales.values() for i in s]
    df = df.withColumns({i: strict_double(F.col(i).cast("string")) for i in items})
    df = df.withColumns({i: reverse_score(F.col(i), scale_max) for i in reverse})
    return z_scores(subscale_means(df, scales), list(scales))

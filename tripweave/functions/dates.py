"""Dates, ages and the weights that follow from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave import constants as K


def iso_date(c: Column) -> Column:
    """Date part of an ISO timestamp text; strict format, bad text gives NULL."""
    day = F.trim(F.get(F.split(c, "T"), F.lit(0)))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("date")


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds to timestamp."""
    return F.timestamp_millis(c)


def age_years(c: Column, reference_year: int) -> Column:
    """Whole years between a timestamp's year and the reference year."""
    return F.lit(reference_year) - F.year(c)


def age_days(c: Column, as_of) -> Column:
    """Whole days up to ``as_of`` (a Column, date or ISO text); future dates give NULL."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    days = F.datediff(as_of, c)
    return F.when(days >= 0, days)


def decay_weight(days: Column, half_life: float | Column = K.HALF_LIFE_DAYS) -> Column:
    """Exponential time decay, 1 at age 0 and 1/2 at one half-life."""
    return F.exp(F.lit(-math.log(2) / half_life) * days)


def view_weight(is_panorama: Column) -> Column:
    """1.0 for a panorama, else 0.75; the flag may be boolean or text."""
    return F.when(F.upper(is_panorama.cast("string")) == "TRUE", 1.0).otherwise(K.PLAIN_VIEW_WEIGHT)

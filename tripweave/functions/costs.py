"""Zone levels, vehicle and public-transport cost, fare text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions.text import strict_double


def zone_level(core_flag: Column, central_flag: Column) -> Column:
    """2 in the core, 1 in the central area, else 0."""
    return F.when(core_flag == 1, 2).when(central_flag == 1, 1).otherwise(0)


def road_charge(origin_level: Column, dest_level: Column) -> Column:
    """Charge for moving between zone levels; pairs not listed cost nothing."""
    out = None
    for (o, d), price in K.ROAD_CHARGE.items():
        hit = (origin_level == o) & (dest_level == d)
        out = F.when(hit, price) if out is None else out.when(hit, price)
    return out.otherwise(0.0)


def parking_fee(dest_level: Column) -> Column:
    """Step price by destination level."""
    out = None
    for level, fee in K.PARKING_FEE.items():
        out = F.when(dest_level == level, fee) if out is None else out.when(dest_level == level, fee)
    return out.otherwise(K.PARKING_FEE_DEFAULT)


def vehicle_cost(distance_km: Column) -> Column:
    """Running cost, linear in distance."""
    return distance_km * K.COST_PER_KM


def transit_cost(minutes: Column, fare: Column, transfers: Column) -> Column:
    """Generalised minutes of a public-transport trip."""
    return minutes + fare / K.VALUE_OF_TIME + transfers * K.TRANSFER_PENALTY_MIN


def car_cost(minutes: Column, money: Column) -> Column:
    """Generalised minutes of a car trip."""
    return minutes + money / K.VALUE_OF_TIME


def survey_cost(car_time: Column, pt_time: Column, car_money: Column, pt_money: Column,
                transfers: Column, opted_out: Column) -> Column:
    """Generalised minutes of a survey alternative: both modes together, 0 for the opt-out."""
    both = (
        car_time + pt_time
        + (car_money + pt_money) / K.VALUE_OF_TIME
        + transfers * K.TRANSFER_PENALTY_MIN
    )
    return F.when(opted_out, 0.0).otherwise(both)


def minutes(seconds: Column) -> Column:
    """Seconds to minutes, missing counts as 0."""
    return F.coalesce(seconds.cast("double"), F.lit(0.0)) / 60


def kilometres(metres: Column) -> Column:
    """Metres to kilometres, missing counts as 0."""
    return F.coalesce(metres.cast("double"), F.lit(0.0)) / 1000


def fare_amount(fare: Column) -> Column:
    """Fare text to ``struct<fare, fare_status>``; unusable text costs 0 and says why."""
    value = strict_double(fare)
    unavailable = F.lower(fare).contains("unavailable")
    status = (
        F.when(fare.isNull(), "NULL")
        .when(unavailable, "INFO_UNAVAILABLE")
        .when(value.isNotNull(), "OK")
        .otherwise(F.concat(F.lit("PARSE_ERROR_"), fare))
    )
    amount = F.when(~unavailable, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return F.struct(amount.alias("fare"), status.alias("fare_status"))

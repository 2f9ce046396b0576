"""Calendar expressions. Weekdays count from Monday = 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_slot(ts: Column) -> Column:
    """Hour of day, 0 to 23."""
    return F.hour(ts)


def weekday_slot(ts: Column) -> Column:
    """Day of week, 0 to 6."""
    return F.weekday(ts)


def hour_of_week(ts: Column) -> Column:
    """Hour of week, 0 to 167."""
    return F.weekday(ts) * 24 + F.hour(ts)


def pooled_slot(ts: Column) -> Column:
    """One slot for all times."""
    return F.lit(0)


#: Slot expressions by granularity.
SLOTS = {"how": hour_of_week, "hod": hour_slot, "dow": weekday_slot, "global": pooled_slot}


def cyclic(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the hour of day and of the day of week."""
    day, week = F.hour(ts) * (2 * math.pi / 24), F.weekday(ts) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)}


def _angle_to(sin: Column, cos: Column, n: int) -> Column:
    return F.pmod(F.round(F.atan2(sin, cos) * (n / (2 * math.pi))).cast("int"), F.lit(n))


def hour_from_cyclic(sin: Column, cos: Column) -> Column:
    return _angle_to(sin, cos, 24)


def weekday_from_cyclic(sin: Column, cos: Column) -> Column:
    return _angle_to(sin, cos, 7)


def site_of(building_id: Column) -> Column:
    """The site is what comes before the first underscore."""
    return F.split(building_id, "_")[0]


# Fixed values of the temperature proxy: yearly mean and its fall per degree of latitude; yearly swing,
# its growth per degree and its bounds; the day and hour where the waves rise through zero; the daily
# swing as a share of the yearly one.
MEAN_C, MEAN_PER_DEGREE = 28.0, 0.55
SWING_C, SWING_PER_DEGREE, SWING_BOUNDS = 4.0, 0.30, (4.0, 30.0)
RISING_DAY, RISING_HOUR, DAILY_SHARE = 100, 5, 0.15


def climate_proxy(ts: Column, lat: Column) -> Column:
    """A climatological temperature (deg C) where none was measured: a mean for the latitude, a
    yearly and a daily wave."""
    swing = F.least(F.greatest(SWING_PER_DEGREE * F.abs(lat) + SWING_C, F.lit(SWING_BOUNDS[0])), F.lit(SWING_BOUNDS[1]))
    year = F.sin((F.dayofyear(ts) + F.hour(ts) / 24.0 - RISING_DAY) * (2 * math.pi / 365.25))
    day = F.sin((F.hour(ts) - RISING_HOUR) * (2 * math.pi / 24))
    return MEAN_C - MEAN_PER_DEGREE * F.abs(lat) + swing * year + DAILY_SHARE * swing * day


def degree_load(temp: Column, cool_from: float, heat_from: float, cool_k: float, heat_k: float) -> Column:
    """Load from degrees above one balance point and below another."""
    zero = F.lit(0.0)
    return cool_k * F.greatest(temp - cool_from, zero) + heat_k * F.greatest(F.lit(heat_from) - temp, zero)

"""Bearings: circular means and compass sectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldobs.functions.rounding import js_round, pg_round

# Compass points, clockwise from north.
COMPASS_16 = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
              "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
COMPASS_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
UNKNOWN_BEARING = "—"


def east_part(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def north_part(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def bearing(mean_east: Column, mean_north: Column) -> Column:
    """Bearing in [0, 360) of a mean vector; null without samples.

    The parts are settled to twelve decimals, so opposite winds cancel to the zero
    vector (bearing 0) and the result does not depend on the order of summation.
    """
    east = mean_east.try_cast("decimal(20,12)").cast("double")
    north = mean_north.try_cast("decimal(20,12)").cast("double")
    return pg_round(F.degrees(F.atan2(east, north)) + 360.0, 6) % F.lit(360.0)


def circular_mean(deg: Column) -> Column:
    return bearing(F.avg(east_part(deg)), F.avg(north_part(deg)))


def whole_degrees(mean: Column) -> Column:
    """A bearing in whole degrees in [0, 360)."""
    return (js_round(mean, 0) % F.lit(360.0)).cast("int")


def circular_mean_int(deg: Column) -> Column:
    return whole_degrees(circular_mean(deg))


def sector_index(deg: Column, sectors: int) -> Column:
    step = 360.0 / sectors
    return F.pmod(F.floor(deg / F.lit(step) + F.lit(0.5)), F.lit(sectors)).cast("int")


def compass(deg: Column) -> Column:
    points = F.array(*[F.lit(p) for p in COMPASS_16])
    return F.coalesce(F.get(points, sector_index(deg, 16)), F.lit(UNKNOWN_BEARING))


def is_calm(speed: Column) -> Column:
    return F.coalesce(speed == 0, F.lit(False))


def bearing_label(deg: Column, speed: Column) -> Column:
    """Compass point, or "Calm" when the wind is still (its bearing means nothing)."""
    return F.when(is_calm(speed), F.lit("Calm")).otherwise(compass(deg))

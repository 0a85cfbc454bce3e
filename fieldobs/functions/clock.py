"""Station-local wall-clock time. A station without a zone runs on UTC."""

from __future__ import annotations

import datetime as dt

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = dt.datetime | str
# Key of the zone list in the metadata of a ``timezone`` column.
ZONES_KEY = "zones"


def instant(value: Instant) -> Column:
    """A literal UTC instant, typed like the stored column so that filters push down."""
    return F.lit(str(value)).cast("timestamp_ntz")


def zone_or_utc(tz: Column) -> Column:
    return F.coalesce(tz, F.lit("UTC"))


def declare_zones(stations: DataFrame, zones: Iterable[str]) -> DataFrame:
    """Note on the ``timezone`` column which zones occur in it."""
    return stations.withMetadata("timezone", {ZONES_KEY: list(zones)})


def declared_zones(stations: DataFrame) -> list[str]:
    return stations.schema["timezone"].metadata.get(ZONES_KEY, [])


def to_local(ts: Column, tz: Column, zones: Iterable[str] = ()) -> Column:
    """Wall-clock time of a UTC instant.

    A zone known when the plan is built is compiled into it; looking a zone up by name
    for every row costs about ten times as much. Zones not listed are looked up.
    """
    local = F.convert_timezone(F.lit("UTC"), zone_or_utc(tz), ts)
    zones = list(zones)
    if not zones:
        return local
    known = F.when(tz.isNull(), ts)
    for zone in zones:
        known = known.when(tz == zone, F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz"))
    return known.otherwise(local)


def to_utc(local: Column, tz: Column) -> Column:
    return F.convert_timezone(zone_or_utc(tz), F.lit("UTC"), local)


def local_midnight(ts: Column, tz: Column) -> Column:
    """UTC instant at which the station's calendar day containing ``ts`` began."""
    return to_utc(to_local(ts, tz).cast("date").cast("timestamp_ntz"), tz)


def hour_start(local: Column) -> Column:
    return F.date_trunc("HOUR", local).cast("timestamp_ntz")


def six_hour_start(local: Column) -> Column:
    """Start of the 00/06/12/18 wall-clock window containing ``local``."""
    return F.window(local, "6 hours")["start"].cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC instant (the session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60e6)


def clock_label(tz: Column, as_of: Instant) -> Column:
    """HH:mm on the station's clock; null when the station has no zone."""
    local = F.convert_timezone(F.lit("UTC"), tz, instant(as_of))
    return F.when(tz.isNotNull(), F.date_format(local, "HH:mm"))


def relative_label(ts: Column, as_of: Instant) -> Column:
    """Age in words, rounding minutes to hours and hours to days in turn."""
    mins = F.floor(minutes_between(instant(as_of), ts) + F.lit(0.5))
    hrs = F.floor(mins / F.lit(60.0) + F.lit(0.5))
    days = F.floor(hrs / F.lit(24.0) + F.lit(0.5))
    return (
        F.when(mins < 1, F.lit("just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago")))
        .when(hrs < 24, F.concat(hrs.cast("string"), F.lit(" hr ago")))
        .when(days == 1, F.lit("1 day ago"))
        .when(days > 1, F.concat(days.cast("string"), F.lit(" days ago")))
    )

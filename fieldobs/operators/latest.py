"""Latest readings, today's figures, staleness: the live view of the network."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldobs.functions import clock, text, wind
from fieldobs.functions.rounding import js_round
from fieldobs.operators import scan, sunshine
from fieldobs.schema import SOURCE_DEVICE

# Minutes without data before a station counts as stale, by source.
STALE_MINUTES = 30
STALE_MINUTES_DEVICE = 120
# Latest rows are sought in this many days first.
RECENT_DAYS = 2


def latest_per_station(readings: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """The newest row of every station.

    ``max_by`` per column keeps fixed-width hash-aggregate buffers, combined map-side:
    a busy station costs one row per task, and nothing is sorted. The instant is unique
    within a station, so all columns come from the same row.
    """
    rows = readings if as_of is None else readings.where(F.col("observed_at") <= clock.instant(as_of))
    rest = [c for c in rows.columns if c not in ("station_id", "observed_at")]
    return rows.groupBy("station_id").agg(
        F.max("observed_at").alias("observed_at"),
        *[F.max_by(c, "observed_at").alias(c) for c in rest])


def latest_rows(stations: DataFrame, readings: DataFrame, as_of: dt.datetime, days: int = RECENT_DAYS,
                daily: DataFrame | None = None, last_seen: DataFrame | None = None) -> DataFrame:
    """``latest_per_station`` for a known dimension, without reading all history.

    ``last_seen`` is the newest row of every station that has any, as a ``ReadingStore`` keeps it:
    it answers by itself. Only if some of its rows are newer than ``as_of``, which one small job
    asks, are the readings of those stations searched.

    Without it the last days come first; older rows are read only for stations silent since. When
    there are none, adaptive execution drops the older branch before its scan starts.
    With the rollup given, one small job asks it for the last day of each silent station, and
    older partitions are left out that cannot hold its latest row: the rollup only says that a
    station has rows on a day, so all days since the earliest of these days are read, however
    far it lags. For a silent station that the rollup doesn't know that is the day it was added
    (``created_at``; all history, where the dimension doesn't say).
    """
    if last_seen is not None:
        newest = last_seen.select(*[c for c in readings.columns if c in last_seen.columns]).join(
            stations.select("station_id"), "station_id", "left_semi")
        told = F.col("observed_at") <= clock.instant(as_of)
        ahead = newest.where(~told).select("station_id")
        if ahead.isEmpty():
            return newest
        sought = latest_rows(ahead, readings.join(ahead, "station_id", "left_semi"), as_of, days, daily)
        return newest.where(told).unionByName(sought.select(*newest.columns))
    since = as_of - dt.timedelta(days=days)
    recent = latest_per_station(scan.readings_since(readings, since, as_of))
    added = F.col("created_at").cast("date") if "created_at" in stations.columns else F.lit(None).cast("date")
    silent = stations.select("station_id", added.alias("added")).join(recent.select("station_id"), "station_id", "left_anti")
    before = readings.where(F.col("observed_at") < clock.instant(since))
    if daily is not None and "obs_date" in readings.columns:
        # A local day reaches from a day before the UTC date of its name to a day after; only one
        # that ended before ``since`` surely has a row that is asked for.
        past = daily.where(F.col("day") < F.lit(since.date() - dt.timedelta(days=1)))
        last = past.join(silent, "station_id", "left_semi").groupBy("station_id").agg(F.max("day").alias("day"))
        reach = F.coalesce("day", "added")
        told = silent.join(last, "station_id", "left").agg(
            F.min(reach).alias("first"), F.count_if(reach.isNull()).alias("unknown")).first()
        if not told["unknown"]:  # without a silent station nothing older is read at all
            first = told["first"]
            before = before.where(F.col("obs_date") >= F.lit(first - dt.timedelta(days=1)) if first else F.lit(False))
    older = latest_per_station(before.join(silent, "station_id", "left_semi"))
    return recent.unionByName(older)


def with_latest(stations: DataFrame, readings: DataFrame, as_of: dt.datetime, *columns: str,
                daily: DataFrame | None = None, last_seen: DataFrame | None = None) -> DataFrame:
    """Stations with the chosen columns of their latest row; nulls where there is none."""
    newest = latest_rows(stations, readings.select(*_scanned(readings, columns)), as_of, daily=daily, last_seen=last_seen)
    return stations.join(newest.select("station_id", "observed_at", *columns), "station_id", "left")


def _scanned(readings: DataFrame, columns: Iterable[str]) -> list[str]:
    """Key and chosen columns, and the partition column where there is one."""
    return ["station_id", "observed_at", *columns, *(c for c in ("obs_date",) if c in readings.columns)]


def wind_1h_avg(readings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mean wind of the trailing hour, one digit."""
    rows = scan.readings_since(readings, as_of - dt.timedelta(hours=1), as_of)
    return rows.groupBy("station_id").agg(js_round(F.avg("wind_speed_kph"), 1).alias("avg_wind_kph"))


def _recent_figures(readings: DataFrame, stations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per station with recent rows: today's figures and the trailing hour's wind, in one pass.

    The scan is bounded to the current days and the last hour, and the aggregates ride along with the sunshine hours, so the rows are shuffled once.
    """
    columns = _scanned(readings, ["temp_c", "wind_speed_kph", "wind_gust_kph", "solar_radiation"])
    hour_ago = clock.instant(as_of - dt.timedelta(hours=1))
    ts = F.col("observed_at")
    today = ts >= F.col("day_start")
    rows = (scan.since_midnight_bound(readings.select(*columns), stations, as_of)
            .where(today | (ts >= hour_ago))
            .withColumn("hour_wind", F.when(ts >= hour_ago, F.col("wind_speed_kph"))))
    # Rows before midnight are only there for the trailing hour.
    for name in ("temp_c", "wind_speed_kph", "wind_gust_kph", "solar_radiation"):
        rows = rows.withColumn(name, F.when(today, F.col(name)))

    carry = {"high": (F.max("temp_c"), F.max("high")), "low": (F.min("temp_c"), F.min("low")),
             "gust": (F.max("wind_gust_kph"), F.max("gust"))}
    means = {"temp_mean": "temp_c", "wind_mean": "wind_speed_kph", "avg_wind_kph": "hour_wind"}
    for out, src in means.items():
        carry[f"{out}_sum"] = (F.sum(src), F.sum(f"{out}_sum"))
        carry[f"{out}_n"] = (F.count(src), F.sum(f"{out}_n"))
    figures = sunshine.elapsed_by(rows, ["station_id"], carry)
    return figures.select(
        "station_id", js_round(F.col("high"), 1).alias("temp_high"), js_round(F.col("low"), 1).alias("temp_low"),
        *[js_round(F.col(f"{out}_sum") / F.nullif(F.col(f"{out}_n"), F.lit(0)), 1).alias(out) for out in means],
        js_round(F.col("gust"), 1).alias("gust"), F.col("sunshine_hours").alias("sunshine"))


TODAY_FIGURES = ["temp_high", "temp_low", "temp_mean", "wind_mean", "gust", "rain", "sunshine"]


def today_stats(readings: DataFrame, stations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """High, low, means, gust and sunshine since each station's own midnight.

    Rain is the gauge of the latest row, whichever day that row is from. Every station
    gets a row.
    """
    rain = with_latest(stations.select("station_id"), readings, as_of, "precip_total_mm")
    return (rain.select("station_id", F.col("precip_total_mm").alias("rain"))
            .join(_recent_figures(readings, stations, as_of), "station_id", "left")
            .select("station_id", *TODAY_FIGURES))


def headline(high: Column, low: Column, rain: Column, gust: Column) -> Column:
    """One line (fixed wording) for a station card; null when there is nothing to say."""
    n = text.number_text
    return text.joined(
        F.when(high.isNotNull() & low.isNotNull(),
               text.sentence("High ", n(high), "° / low ", n(low), "°")),
        F.when(rain > 0, text.sentence(n(js_round(rain, 1)), " mm rain")).when(rain.isNotNull(), "dry"),
        F.when(gust > 0, text.sentence("gusts to ", n(gust), " km/h")))


def station_cards(stations: DataFrame, readings: DataFrame, as_of: dt.datetime,
                  daily: DataFrame | None = None, last_seen: DataFrame | None = None) -> DataFrame:
    """Stations with latest reading, trailing-hour wind, today's figures and headline.

    Reads the last days only, unless a station has been silent for longer and no table of newest
    rows is given (``latest_rows``).
    """
    latest_columns = ["temp_c", "temp_indoor_c", "wind_speed_kph", "precip_total_mm"]
    cards = (with_latest(stations, readings, as_of, *latest_columns, daily=daily, last_seen=last_seen)
             .join(_recent_figures(readings, stations, as_of), "station_id", "left")
             .withColumn("rain", F.col("precip_total_mm")))
    return cards.withColumn("summary", headline(
        F.col("temp_high"), F.col("temp_low"), F.col("rain"), F.col("gust")))


def current_conditions(latest: DataFrame) -> DataFrame:
    """Text line, compass point and calm flag of each latest reading."""
    n = text.number_text
    deg, speed = F.col("wind_dir"), F.col("wind_speed_kph")
    line = text.joined(
        text.sentence("Feels like ", n(F.col("feels_like_c")), "°"),
        text.sentence("Humidity ", n(F.col("humidity")), "%"),
        text.sentence("Wind ", n(speed), " km/h ", wind.compass(deg)))
    return latest.select("station_id", "observed_at", line.alias("conditions"),
                         wind.is_calm(speed).alias("calm"), wind.bearing_label(deg, speed).alias("bearing"))


def stale_minutes(source: Column) -> Column:
    return F.when(source == SOURCE_DEVICE, STALE_MINUTES_DEVICE).otherwise(STALE_MINUTES)


def is_stale(observed_at: Column, source: Column, as_of: dt.datetime) -> Column:
    return clock.minutes_between(clock.instant(as_of), observed_at) > stale_minutes(source)


def _fresh(stations: DataFrame, readings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Ids of stations with a reading inside their source's limit.

    Only the rows of the longest limit are read; they shrink to one instant per station
    before meeting the dimension.
    """
    longest = max(STALE_MINUTES, STALE_MINUTES_DEVICE)
    recent = scan.readings_since(readings, as_of - dt.timedelta(minutes=longest), as_of)
    newest = recent.groupBy("station_id").agg(F.max("observed_at").alias("newest"))
    return (newest.join(stations.select("station_id", "source"), "station_id")
            .where(~is_stale(F.col("newest"), F.col("source"), as_of)).select("station_id"))


def stale_stations(stations: DataFrame, readings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Stations without a fresh reading, with a message each."""
    limit = stale_minutes(F.col("source"))
    return stations.join(_fresh(stations, readings, as_of), "station_id", "left_anti").select(
        "station_id", "name", "source", limit.alias("limit_minutes"),
        F.format_string("%s (%s): no data in last %d minutes", F.col("name"),
                        F.col("wunderground_id"), limit).alias("issue"))


def network_health(stations: DataFrame, readings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row: stations, stale stations, and the overall status."""
    fresh = _fresh(stations, readings, as_of).withColumn("fresh", F.lit(True))
    status = (F.when(F.col("stations") == 0, "error").when(F.col("stale") == 0, "healthy")
              .otherwise("unhealthy"))
    return (stations.select("station_id").join(fresh, "station_id", "left")
            .agg(F.count(F.lit(1)).alias("stations"), F.count_if(F.col("fresh").isNull()).alias("stale"))
            .withColumn("status", status))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key. Spark limits each map task to one row per key before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")

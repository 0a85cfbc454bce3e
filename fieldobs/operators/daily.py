"""Daily rollup by station-local day, directly or from 15-minute partials."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock, wind
from fieldobs.functions.rounding import js_round, pg_round
from fieldobs.operators import scan
from fieldobs.schema import DAILY_COLUMNS

# Bright-sunshine threshold in W/m², collection cadence in minutes.
SUNNY_WM2 = 120
CADENCE_MINUTES = 10

# Rollup column <- averaged measurement, and digits kept.
MEANS = {
    "temp_avg": ("temp_c", 1),
    "temp_indoor_c": ("temp_indoor_c", 1),
    "feels_like_c": ("feels_like_c", 1),
    "dewpoint_c": ("dewpoint_c", 1),
    "humidity": ("humidity", 1),
    "humidity_indoor": ("humidity_indoor", 1),
    "pressure_mb": ("pressure_mb", 1),
    "wind_speed_kph": ("wind_speed_kph", 1),
    "uv": ("uv", 1),
    "solar_radiation": ("solar_radiation", 0),
}
PEAKS = {
    "temp_max": ("temp_c", 1),
    "wind_gust_kph": ("wind_gust_kph", 1),
    "precip_total_mm": ("precip_total_mm", 2),
    "precip_rate_mm": ("precip_rate_mm", 2),
}
LOWS = {"temp_min": ("temp_c", 1)}


def sunshine_from_counts(sunny: Column, samples: Column) -> Column:
    """Hours at or above the threshold, one cadence step per reading; null without a sensor."""
    return F.when(samples > 0, pg_round(sunny * float(CADENCE_MINUTES) / 60.0, 1))


def is_sunny(solar: Column) -> Column:
    return solar >= SUNNY_WM2


def daily_aggregates() -> list[Column]:
    aggs = [pg_round(F.avg(src), n).alias(out) for out, (src, n) in MEANS.items()]
    aggs += [pg_round(F.max(src), n).alias(out) for out, (src, n) in PEAKS.items()]
    aggs += [pg_round(F.min(src), n).alias(out) for out, (src, n) in LOWS.items()]
    solar = F.col("solar_radiation")
    aggs.append(wind.circular_mean(F.col("wind_dir")).alias("wind_dir"))
    aggs.append(sunshine_from_counts(F.count_if(is_sunny(solar)), F.count(solar)).alias("sunshine_hours"))
    return aggs


def daily_rollup(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per station and local day. Every aggregate combines map-side."""
    return (scan.with_local_time(readings, stations)
            .groupBy("station_id", F.col("local_day").alias("day"))
            .agg(*daily_aggregates())
            .select(*DAILY_COLUMNS))


def readings_daily(readings: DataFrame, stations: DataFrame, since: dt.datetime,
                   station_ids: Iterable | None = None) -> DataFrame:
    """Rollup of the raw rows from an instant on; its first day may be partial."""
    rows = readings.where(F.col("observed_at") >= clock.instant(since))
    return daily_rollup(scan.of_stations(rows, station_ids), stations)


def sunshine_daily_count(readings: DataFrame, stations: DataFrame) -> DataFrame:
    solar = F.col("solar_radiation")
    return (scan.with_local_time(readings, stations)
            .groupBy("station_id", F.col("local_day").alias("day"))
            .agg(sunshine_from_counts(F.count_if(is_sunny(solar)), F.count(solar)).alias("sunshine_hours")))


def daily_min_avg_max(readings: DataFrame, stations: DataFrame, metric: str) -> DataFrame:
    """Per local day with samples: mean to one digit, extremes as measured."""
    m = F.col(metric)
    return (scan.with_local_time(readings.where(m.isNotNull()), stations)
            .groupBy("station_id", F.col("local_day").alias("day"))
            .agg(js_round(F.avg(m), 1).alias("avg"), F.min(m).alias("min"), F.max(m).alias("max")))


# ---- mergeable 15-minute partials ----------------------------------------
# Fifteen minutes divides every zone offset in use, so partials keyed by UTC time
# compose into any local hour, 6-hour bucket or day. They need no station zone:
# the dimension join then meets a few rows per hour instead of every reading.

PARTIAL_MINUTES = 15


def partial_aggregates() -> list[Column]:
    aggs = []
    # Chart points are means of any of these, also of those the rollup takes the peak of.
    for src in dict.fromkeys(src for src, _ in (*MEANS.values(), *PEAKS.values())):
        aggs += [F.sum(F.col(src).cast("double")).alias(f"{src}__sum"), F.count(src).alias(f"{src}__n")]
    for src in dict.fromkeys(src for src, _ in PEAKS.values()):
        aggs.append(F.max(src).alias(f"{src}__max"))
    for src in dict.fromkeys(src for src, _ in LOWS.values()):
        aggs.append(F.min(src).alias(f"{src}__min"))
    deg = F.col("wind_dir")
    aggs += [F.sum(wind.east_part(deg)).alias("wind_east"), F.sum(wind.north_part(deg)).alias("wind_north"),
             F.count(deg).alias("wind_n"), F.count_if(is_sunny(F.col("solar_radiation"))).alias("sunny_n")]
    return aggs


def quarter_hour_partials(readings: DataFrame) -> DataFrame:
    bucket = F.window(F.col("observed_at"), f"{PARTIAL_MINUTES} minutes")["start"]
    return (readings.groupBy("station_id", bucket.alias("bucket_start")).agg(*partial_aggregates()))


def rollup_from_partials(partials: DataFrame, stations: DataFrame) -> DataFrame:
    """The daily rollup from 15-minute partials: same values as ``daily_rollup``."""
    def mean(src: str) -> Column:
        return F.sum(f"{src}__sum") / F.nullif(F.sum(f"{src}__n"), F.lit(0))

    aggs = [pg_round(mean(src), n).alias(out) for out, (src, n) in MEANS.items()]
    aggs += [pg_round(F.max(f"{src}__max"), n).alias(out) for out, (src, n) in PEAKS.items()]
    aggs += [pg_round(F.min(f"{src}__min"), n).alias(out) for out, (src, n) in LOWS.items()]
    n = F.nullif(F.sum("wind_n"), F.lit(0))
    aggs.append(wind.bearing(F.sum("wind_east") / n, F.sum("wind_north") / n).alias("wind_dir"))
    aggs.append(sunshine_from_counts(F.sum("sunny_n"), F.sum("solar_radiation__n")).alias("sunshine_hours"))
    local = partials.withColumnRenamed("bucket_start", "observed_at")
    return (scan.with_local_time(local, stations)
            .groupBy("station_id", F.col("local_day").alias("day")).agg(*aggs)
            .select(*DAILY_COLUMNS))

"""Chart buckets on the station's clock: six hours, days, hours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock, text, wind
from fieldobs.functions.rounding import js_round
from fieldobs.operators import scan


def bucket_mean(metric: str) -> Column:
    """Mean to one digit; bearings average as vectors, to whole degrees."""
    if metric == "wind_dir":
        return wind.circular_mean_int(F.col(metric)).alias(metric)
    return js_round(F.avg(metric), 1).alias(metric)


def bucket_6h(readings: DataFrame, stations: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """00/06/12/18 wall-clock buckets; only the midnight bucket carries a day label."""
    start = clock.six_hour_start(F.col("local_ts"))
    rows = (scan.with_local_time(readings, stations)
            .groupBy("station_id", start.alias("bucket_start"))
            .agg(*[bucket_mean(m) for m in metrics]))
    return with_6h_labels(rows)


def partial_mean(metric: str) -> Column:
    """``bucket_mean`` over quarter-hour partials."""
    if metric == "wind_dir":
        n = F.nullif(F.sum("wind_n"), F.lit(0))
        mean = wind.bearing(F.sum("wind_east") / n, F.sum("wind_north") / n)
        return wind.whole_degrees(mean).alias(metric)
    return js_round(F.sum(f"{metric}__sum") / F.nullif(F.sum(f"{metric}__n"), F.lit(0)), 1).alias(metric)


def _local_partials(partials: DataFrame, stations: DataFrame) -> DataFrame:
    """Partials on the station's clock: every zone's offset is whole quarter hours, so none straddles an hour."""
    return scan.with_local_time(partials.withColumn("observed_at", F.col("bucket_start").cast("timestamp_ntz")).drop("bucket_start"), stations)


def bucket_6h_from_partials(partials: DataFrame, stations: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """``bucket_6h`` from a live table of partials, without its readings: at most 24 rows a bucket."""
    start = clock.six_hour_start(F.col("local_ts"))
    rows = (_local_partials(partials, stations).groupBy("station_id", start.alias("bucket_start"))
            .agg(*[partial_mean(m) for m in metrics]))
    return with_6h_labels(rows)


def bucket_daily_from_partials(partials: DataFrame, stations: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """``bucket_daily`` from partials."""
    return (_local_partials(partials, stations).groupBy("station_id", F.col("local_day").alias("day"))
            .agg(*[partial_mean(m) for m in metrics]).withColumn("label", text.axis_day(F.col("day"))))


def hourly_wind_from_partials(partials: DataFrame, stations: DataFrame) -> DataFrame:
    """``hourly_wind_direction`` from partials."""
    return (_local_partials(partials.where("wind_n > 0"), stations)
            .groupBy("station_id", clock.hour_start(F.col("local_ts")).alias("hour_start"))
            .agg(partial_mean("wind_dir").alias("direction"))
            .withColumn("label", text.hour_label(F.col("hour_start"))))


def with_6h_labels(rows: DataFrame) -> DataFrame:
    start = F.col("bucket_start")
    label, day = text.hour_label(start), text.weekday_day(start)
    return (rows.withColumn("label", label)
            .withColumn("day_label", F.when(F.hour(start) == 0, day))
            .withColumn("full_label", F.concat(day, F.lit(", "), label)))


def bucket_daily(readings: DataFrame, stations: DataFrame, metrics: Iterable[str]) -> DataFrame:
    return (scan.with_local_time(readings, stations)
            .groupBy("station_id", F.col("local_day").alias("day"))
            .agg(*[bucket_mean(m) for m in metrics])
            .withColumn("label", text.axis_day(F.col("day"))))


def hourly_wind_direction(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Vector-mean bearing of each local clock hour that has samples."""
    deg = F.col("wind_dir")
    return (scan.with_local_time(readings.where(deg.isNotNull()), stations)
            .groupBy("station_id", clock.hour_start(F.col("local_ts")).alias("hour_start"))
            .agg(wind.circular_mean_int(deg).alias("direction"))
            .withColumn("label", text.hour_label(F.col("hour_start"))))


def wind_rose(readings: DataFrame) -> DataFrame:
    """Share of each station's bearings per compass octant; every octant is listed."""
    deg = F.col("wind_dir")
    seen = readings.where(deg.isNotNull()).select("station_id", wind.sector_index(deg, 8).alias("sector"))
    counts = seen.groupBy("station_id").agg(
        *[F.count_if(F.col("sector") == i).alias(f"s{i}") for i in range(8)])
    total = sum((F.col(f"s{i}") for i in range(8)), F.lit(0))
    octants = F.array(*[
        F.struct(F.lit(i).alias("sector"), F.lit(name).alias("direction"), F.col(f"s{i}").alias("n"))
        for i, name in enumerate(wind.COMPASS_8)])
    return (counts.select("station_id", total.alias("total"), F.explode(octants).alias("o"))
            .select("station_id", "o.sector", "o.direction",
                    js_round(F.col("o.n") / F.col("total") * 100.0, 1).alias("share_pct")))


def wind_mean(readings: DataFrame) -> DataFrame:
    """Vector-mean bearing per station: exact form, whole degrees and compass point."""
    mean = wind.circular_mean(F.col("wind_dir"))
    whole = wind.circular_mean_int(F.col("wind_dir"))
    return (readings.groupBy("station_id").agg(mean.alias("wind_dir"), whole.alias("wind_dir_int"))
            .withColumn("compass", wind.compass(F.col("wind_dir"))))

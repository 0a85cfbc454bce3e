"""Rule-based summaries of a window, from daily rows or from raw readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock, text
from fieldobs.functions.rounding import js_round
from fieldobs.operators import scan, sunshine
from fieldobs.operators.latest import first_by

# Wet-day threshold in mm, pressure change in hPa that makes a trend.
WET_MM = 0.2
TREND_HPA = 1.0


def extreme_day(daily: DataFrame, metric: str, lowest: bool = False) -> DataFrame:
    """Per station the day with the highest (or lowest) value; the earlier day wins a tie.

    A station has one row per day, so ranking one station's rows stays small.
    """
    order = F.asc(metric) if lowest else F.desc(metric)
    rows = daily.where(F.col(metric).isNotNull()).select("station_id", "day", metric)
    return first_by(rows, ["station_id"], order, F.asc("day"))


def summary_daily_stats(daily: DataFrame) -> DataFrame:
    """Means, totals and record days per station over a window of daily rows, in one pass.

    A record is the least (value or -value, day) struct: the earlier day wins a tie.
    """
    c = F.col

    def record(metric: str, lowest: bool = False) -> Column:
        rank = c(metric) if lowest else -c(metric)
        entry = F.struct(rank.alias("rank"), "day", c(metric).alias("value"))
        return F.min(F.when(c(metric).isNotNull(), entry))

    records = {"warmest": record("temp_max"), "coldest": record("temp_min", lowest=True),
               "gust": record("wind_gust_kph")}
    stats = daily.groupBy("station_id").agg(
        js_round(F.avg("temp_avg"), 1).alias("temp_mean"),
        js_round(F.coalesce(F.sum("precip_total_mm"), F.lit(0.0)), 1).alias("rain_total"),
        F.count_if(c("precip_total_mm") > WET_MM).alias("wet_days"),
        js_round(F.sum("sunshine_hours"), 1).alias("sun_total"),
        F.count("sunshine_hours").alias("sun_days"),
        *[struct.alias(f"_{name}") for name, struct in records.items()])
    return stats.select(
        "station_id", "temp_mean", "rain_total", "wet_days", "sun_total", "sun_days",
        js_round(c("sun_total") / F.nullif(c("sun_days"), F.lit(0)), 1).alias("sun_per_day"),
        *[c(f"_{n}.value").alias(n) for n in records], *[c(f"_{n}.day").alias(f"{n}_day") for n in records])


# The wording of the sentences below.

def summary_daily_text(stats: DataFrame, label: str) -> DataFrame:
    c, n, say, day = F.col, text.number_text, text.sentence, text.day_short
    temp = say("Averaged ", n(c("temp_mean")), f"°C over {label}. Warmest ", n(c("warmest")), "°C (",
               day(c("warmest_day")), "), coldest ", n(c("coldest")), "°C (", day(c("coldest_day")), ").")
    rain = F.when(c("wet_days") == 0, "No measurable rain.").otherwise(
        say(n(c("rain_total")), " mm of rain across ", c("wet_days").cast("string"),
            text.plural(c("wet_days"), "day"), "."))
    gust = say("Windiest day peaked at ", n(js_round(c("gust"), 1)), " km/h (", day(c("gust_day")), ").")
    sun = say(n(c("sun_total")), " hours of sunshine, averaging ", n(c("sun_per_day")), " h/day.")
    return stats.select("station_id", text.lines(temp, rain, gust, sun).alias("lines"))


def rainfall_window(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Rain and wet days per station from a gauge that accumulates over each local day."""
    return _rain_totals(_per_day(readings, stations))


def pressure_trend(readings: DataFrame) -> DataFrame:
    """Last minus first pressure per station and its direction; null below two readings."""
    p = F.col("pressure_mb")
    rows = readings.where(p.isNotNull())
    ends = rows.groupBy("station_id").agg(
        F.count(p).alias("n"), F.min_by(p, "observed_at").alias("first"), F.max_by(p, "observed_at").alias("last"))
    return ends.select("station_id", *_trend(F.col("n"), F.col("first"), F.col("last")))


def _trend(n: Column, first: Column, last: Column) -> list[Column]:
    change = F.when(n >= 2, js_round(last - first, 1))
    direction = (F.when(F.abs(change) < TREND_HPA, "steady").when(change > 0, "rising")
                 .when(change < 0, "falling"))
    return [change.alias("pressure_change"), direction.alias("trend")]


def _per_day(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Everything a window needs, reduced to one row per station and local day first."""
    p, ts = F.col("pressure_mb"), F.col("observed_at")
    p_ts = F.when(p.isNotNull(), ts)
    return (scan.with_local_time(readings, stations).groupBy("station_id", F.col("local_day").alias("day")).agg(
        F.sum("temp_c").alias("temp_sum"), F.count("temp_c").alias("temp_n"),
        F.max("precip_total_mm").alias("gauge"), F.max("wind_gust_kph").alias("gust"),
        F.count(p).alias("p_n"), F.min(p_ts).alias("p_from"), F.max(p_ts).alias("p_to"),
        F.min_by(p, p_ts).alias("p_first"), F.max_by(p, p_ts).alias("p_last")))


def _rain_aggregates() -> list[Column]:
    gauge = F.greatest(F.col("gauge"), F.lit(0.0))
    known = F.when(F.col("gauge").isNotNull(), gauge)
    return [js_round(F.sum(known), 1).alias("rain_total"), F.count_if(known > WET_MM).alias("wet_days"),
            F.count(known).alias("gauge_days")]


def _rain_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("station_id").agg(*_rain_aggregates()).where(F.col("gauge_days") > 0).drop("gauge_days")


def sunshine_and_extremes(readings: DataFrame, stations: DataFrame, metric: str) -> DataFrame:
    """Per station the hours of sunshine, and the highest and lowest value of a metric with the
    earliest local moment of each: one pass over the readings."""
    c, zones = F.col, clock.declared_zones(stations)
    rows = readings.select("station_id", "observed_at", "solar_radiation", metric)
    figures = scan.with_zone(sunshine.elapsed_by(rows, ["station_id"], extremes=metric), stations)

    def local(us: Column) -> Column:
        return clock.to_local(F.timestamp_micros(us).cast("timestamp_ntz"), c("timezone"), zones)

    return figures.select(
        "station_id", (-c("high.rank")).alias("high"), c("low.rank").alias("low"),
        local(c("high.us")).alias("high_at"), local(c("low.us")).alias("low_at"), "sunshine_hours")


def summary_period_stats(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Figures of a window of raw readings per station, in two passes over them."""
    c = F.col
    per_day = _per_day(readings, stations)
    totals = per_day.groupBy("station_id").agg(
        js_round(F.sum("temp_sum") / F.nullif(F.sum("temp_n"), F.lit(0)), 1).alias("temp_mean"),
        *_rain_aggregates(), js_round(F.max("gust"), 1).alias("peak_gust"), F.sum("p_n").alias("p_n"),
        F.min_by("p_first", "p_from").alias("p_first"), F.max_by("p_last", "p_to").alias("p_last"))
    return (totals.select("station_id", "temp_mean", "rain_total", "wet_days", "gauge_days", "peak_gust",
                          *_trend(c("p_n"), c("p_first"), c("p_last")))
            .join(sunshine_and_extremes(readings, stations, "temp_c"), "station_id", "left"))


def summary_period_text(stats: DataFrame, label: str) -> DataFrame:
    c, n, say, at = F.col, text.number_text, text.sentence, text.weekday_clock
    temp = say("Average ", n(c("temp_mean")), f"°C in {label}. High of ", n(c("high")), "°C (",
               at(c("high_at")), "), low of ", n(c("low")), "°C (", at(c("low_at")), ").")
    rain = F.when(c("gauge_days") > 0, F.when(c("wet_days") == 0, "No measurable rain.").otherwise(
        say(n(c("rain_total")), " mm of rain across ", c("wet_days").cast("string"),
            text.plural(c("wet_days"), "wet day"), ".")))
    gust = say("Peak gust ", n(c("peak_gust")), " km/h.")
    hours = c("sunshine_hours")
    sun = say(n(hours), text.plural(hours, "hour"), " of sunshine.")
    change = c("pressure_change")
    sign = F.when(change > 0, "+").otherwise("")
    pressure = say("Pressure ", c("trend"), F.when(
        F.abs(change) >= TREND_HPA, say(" (", sign, n(change), " hPa)")).otherwise(""), ".")
    return stats.select("station_id", text.lines(temp, rain, gust, sun, pressure).alias("lines"))

"""Period against period and station against station, over daily rows or raw days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import text
from fieldobs.functions.rounding import js_round
from fieldobs.operators import scan
from fieldobs.plans.timewin import Period, day_of_period

# Daily column -> (raw column, how a period total is formed).
METRICS: dict[str, tuple[str, str]] = {
    "temp_avg": ("temp_c", "mean"),
    "precip_total_mm": ("precip_total_mm", "sum"),
    "humidity": ("humidity", "mean"),
    "wind_speed_kph": ("wind_speed_kph", "mean"),
    "pressure_mb": ("pressure_mb", "mean"),
    "uv": ("uv", "mean"),
    "solar_radiation": ("solar_radiation", "mean"),
    "sunshine_hours": ("", "sum"),
    "humidity_indoor": ("humidity_indoor", "mean"),
}
RAW_METRICS = {key: raw_kind for key, raw_kind in METRICS.items() if raw_kind[0]}
STATION_TABLE = {
    "temp_avg": "mean", "temp_max": "max", "temp_min": "min", "precip_total_mm": "sum",
    "sunshine_hours": "sum", "wind_speed_kph": "mean", "humidity": "mean", "pressure_mb": "mean",
}
SIDES = ("a", "b")


def _inside(day: Column, period: Period) -> Column:
    return (day >= F.lit(period.start)) & (day < F.lit(period.end))


def _side_rows(rows: DataFrame, day: Column, a: Period, b: Period) -> DataFrame:
    """One scan for both periods: each row once per period it falls in, with that period's start."""
    sides = F.array(*[
        F.when(_inside(day, p), F.struct(F.lit(side).alias("side"), F.lit(p.start).alias("start")))
        for side, p in zip(SIDES, (a, b))])
    return (rows.where(_inside(day, a) | _inside(day, b))
            .withColumn("_s", F.explode(F.array_compact(sides)))
            .select("*", "_s.side", "_s.start").drop("_s"))


def _on(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def compare_periods_aligned(daily: DataFrame, a: Period, b: Period) -> DataFrame:
    """Daily metrics of both periods side by side, by day of period.

    A full outer merge; the key (station, side, day) is unique, so one grouped pass with
    conditional aggregates does it without joining the rollup to itself.
    """
    day = F.col("day")
    rows = _side_rows(daily, day, a, b).withColumn("idx", day_of_period(day, F.col("start")))
    return rows.groupBy("station_id", "idx").agg(*[
        F.max(_on(side, F.col(m))).alias(f"{m}_{side}") for m in METRICS for side in SIDES])


def _two_days(readings: DataFrame, stations: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    """Raw rows of two local days: each day's bound on the stored instant goes to the scan."""
    one = dt.timedelta(days=1)
    first = scan.in_local_days(readings, stations, a, a + one).withColumn("side", F.lit("a"))
    second = scan.in_local_days(readings, stations, b, b + one).withColumn("side", F.lit("b"))
    return first.unionByName(second)


def compare_days_hourly(readings: DataFrame, stations: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    """Means per local hour of two days, side by side."""
    rows = _two_days(readings, stations, a, b)
    return rows.groupBy("station_id", F.hour("local_ts").alias("idx")).agg(*[
        js_round(F.avg(_on(side, F.col(raw))), 1).alias(f"{m}_{side}")
        for m, (raw, _) in RAW_METRICS.items() for side in SIDES])


def _with_deltas(stats: DataFrame, metrics: Iterable[str]) -> DataFrame:
    return stats.select("*", *[
        js_round(F.col(f"{m}_a") - F.col(f"{m}_b"), 1).alias(f"{m}_delta") for m in metrics])


def compare_period_stats(daily: DataFrame, a: Period, b: Period) -> DataFrame:
    """Mean or sum of each metric per period, and the difference."""
    fold = {"mean": F.avg, "sum": F.sum}
    stats = _side_rows(daily, F.col("day"), a, b).groupBy("station_id").agg(*[
        js_round(fold[kind](_on(side, F.col(m))), 1).alias(f"{m}_{side}")
        for m, (_, kind) in METRICS.items() for side in SIDES])
    return _with_deltas(stats, METRICS)


def compare_day_stats(readings: DataFrame, stations: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    """Two single days from raw rows; a gauge that accumulates over the day counts by its peak."""
    fold = {"mean": F.avg, "sum": F.max}
    stats = _two_days(readings, stations, a, b).groupBy("station_id").agg(*[
        js_round(fold[kind](_on(side, F.col(raw))), 1).alias(f"{m}_{side}")
        for m, (raw, kind) in RAW_METRICS.items() for side in SIDES])
    return _with_deltas(stats, RAW_METRICS)


def compare_stations(requested: DataFrame, stations: DataFrame, series: DataFrame,
                     columns: Sequence[str]) -> DataFrame:
    """Requested ids with names and daily series; an unknown id names itself, and an id
    without data keeps one row of nulls."""
    names = stations.select("station_id", "name")
    return (requested.join(names, "station_id", "left")
            .withColumn("name", F.coalesce("name", F.col("station_id").cast("string")))
            .join(series.select("station_id", "day", *columns), "station_id", "left"))


def compare_stations_table(daily: DataFrame) -> DataFrame:
    """One figure per station and metric: mean, peak, low or total."""
    fold = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    return daily.groupBy("station_id").agg(*[
        js_round(fold[kind](m), 1).alias(m) for m, kind in STATION_TABLE.items()])


def multi_station_pivot(daily: DataFrame, station_ids: Sequence, metric: str) -> DataFrame:
    """One row per day with a column per station (s0, s1, ...)."""
    rows = scan.of_stations(daily, station_ids)
    return rows.groupBy("day").agg(*[
        F.max(F.when(F.col("station_id") == sid, F.col(metric))).alias(f"s{i}")
        for i, sid in enumerate(station_ids)])


def distinct_days(*series: DataFrame) -> DataFrame:
    days = series[0].select("day")
    for other in series[1:]:
        days = days.union(other.select("day"))
    return days.distinct()


def temp_band(daily: DataFrame) -> DataFrame:
    """[min, max] per day; null unless both are known."""
    low, high = F.col("temp_min"), F.col("temp_max")
    return daily.withColumn("band", F.when(low.isNotNull() & high.isNotNull(), F.array(low, high)))


def compare_summary_stats(daily: DataFrame, a: Period, b: Period) -> DataFrame:
    """Temperature, rain and wind of both periods, unrounded inputs to the sentences."""
    c = F.col
    aggs = []
    for side in SIDES:
        aggs += [F.count(_on(side, F.lit(1))).alias(f"days_{side}"),
                 F.avg(_on(side, c("temp_avg"))).alias(f"temp_{side}"),
                 F.coalesce(F.sum(_on(side, c("precip_total_mm"))), F.lit(0.0)).alias(f"rain_{side}"),
                 F.avg(_on(side, c("wind_speed_kph"))).alias(f"wind_{side}")]
    stats = _side_rows(daily, c("day"), a, b).groupBy("station_id").agg(*aggs)
    return stats.select(
        "station_id", "days_a", "days_b",
        *[js_round(c(f"{m}_{s}"), 1).alias(f"{m}_{s}") for m in ("temp", "rain", "wind") for s in SIDES],
        *[js_round(c(f"{m}_a") - c(f"{m}_b"), 1).alias(f"{m}_diff") for m in ("temp", "rain", "wind")])


def summary_comparison_text(stats: DataFrame, a_label: str, b_label: str) -> DataFrame:
    """Sentences (fixed wording) comparing the periods. Differences below 0.1 °C, 0.5 mm or 0.5 km/h are no change."""
    c, n, say = F.col, text.number_text, text.sentence

    def size(m: str) -> Column:
        return n(F.abs(c(f"{m}_diff")))

    temp_phrase = F.when(F.abs(c("temp_diff")) < 0.1, say("about the same temperature as ", b_label)).otherwise(
        say(size("temp"), "°C ", F.when(c("temp_diff") > 0, "warmer").otherwise("cooler"), " than ", b_label))
    temp_line = F.when(
        c("temp_a").isNotNull() & c("temp_b").isNotNull(),
        say(a_label, " averaged ", n(c("temp_a")), "°C — ", temp_phrase, " (", n(c("temp_b")), "°C).")
    ).when(c("temp_a").isNotNull(),
           say(a_label, " averaged ", n(c("temp_a")), f"°C (no comparison data for {b_label} yet)."))
    rain_phrase = F.when(F.abs(c("rain_diff")) < 0.5, "a similar amount").otherwise(
        say(size("rain"), " mm ", F.when(c("rain_diff") > 0, "more").otherwise("less")))
    rain_line = F.when(
        (c("days_a") > 0) & (c("days_b") > 0),
        say("Rainfall totalled ", n(c("rain_a")), " mm vs ", n(c("rain_b")), " mm — ", rain_phrase, ".")
    ).when(c("days_a") > 0, say("Rainfall totalled ", n(c("rain_a")), " mm."))
    wind_phrase = F.when(F.abs(c("wind_diff")) < 0.5, "similar winds").otherwise(
        say(F.when(c("wind_diff") > 0, "windier").otherwise("calmer"), " on average"))
    wind_line = F.when(
        c("wind_a").isNotNull() & c("wind_b").isNotNull(),
        say("Average wind ", n(c("wind_a")), " km/h vs ", n(c("wind_b")), " km/h — ", wind_phrase, "."))
    return stats.select("station_id", text.lines(temp_line, rain_line, wind_line).alias("lines"))

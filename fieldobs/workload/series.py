"""Queries over raw readings: scans, daily rollups, buckets, sunshine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock
from fieldobs.functions.wind import compass
from fieldobs.operators import buckets, daily, latest, scan, sunshine
from fieldobs.plans import sqlfunctions, timewin
from fieldobs.schema import DAILY_COLUMNS
from fieldobs.workload import sql as S
from fieldobs.workload.adapters import AS_OF, DAILY_AS_OF, Tables
from fieldobs.workload.registry import query

BASE = [S.STATIONS, S.READINGS, S.LOCAL]
METRICS = ["temp_c", "humidity", "pressure_mb", "wind_speed_kph", "precip_total_mm", "solar_radiation", "wind_dir"]
_means = ", ".join([*[f"{S.jr(f'avg({m})', 1)} AS {m}" for m in METRICS[:-1]], f"{S.circ_int('wind_dir')} AS wind_dir"])


@query("readings_daily", S.select(
    [*BASE, S.rollup(f"observed_at >= {S.AS_OF} - INTERVAL 20 DAY")], f"SELECT {S.DAILY_LIST} FROM rollup"))
def readings_daily(t: Tables) -> DataFrame:
    return daily.readings_daily(t.readings, t.stations, AS_OF - dt.timedelta(days=20))


@query("rollup_daily", S.select([*BASE, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def rollup_daily(t: Tables) -> DataFrame:
    return daily.daily_rollup(t.readings, t.stations)


@query("rollup_from_partials", S.select([*BASE, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def rollup_from_partials(t: Tables) -> DataFrame:
    return daily.rollup_from_partials(daily.quarter_hour_partials(t.readings), t.stations)


@query("readings_window", S.select([S.READINGS], """
SELECT station_id, observed_at, temp_c, humidity, wind_speed_kph, precip_total_mm FROM readings
WHERE observed_at >= TIMESTAMP '2024-01-10 06:00:00' AND observed_at < TIMESTAMP '2024-01-17 06:00:00'"""))
def readings_window(t: Tables) -> DataFrame:
    rows = scan.readings_between(t.readings, "2024-01-10 06:00:00", "2024-01-17 06:00:00")
    return rows.select("station_id", "observed_at", "temp_c", "humidity", "wind_speed_kph", "precip_total_mm")


@query("range_today", S.select([S.STATIONS, S.READINGS, S.TODAY], f"SELECT {S.READING_COLUMNS} FROM today"))
def range_today(t: Tables) -> DataFrame:
    return scan.today_so_far(t.readings, t.stations, AS_OF).select(*t.readings.columns)


@query("range_7d", S.select([S.READINGS], f"""
SELECT {S.READING_COLUMNS} FROM readings
WHERE observed_at >= {S.AS_OF} - INTERVAL 7 DAY AND observed_at <= {S.AS_OF}"""))
def range_7d(t: Tables) -> DataFrame:
    return scan.readings_since(t.readings, timewin.range_start("7d", AS_OF), AS_OF)


@query("range_30d", S.select(
    [*BASE, S.rollup(f"observed_at >= {S.AS_OF} - INTERVAL 30 DAY AND observed_at <= {S.AS_OF}")],
    f"SELECT {S.DAILY_LIST} FROM rollup"))
def range_30d(t: Tables) -> DataFrame:
    rows = scan.readings_since(t.readings, timewin.range_start("30d", AS_OF), AS_OF)
    return daily.daily_rollup(rows, t.stations)


@query("range_1y", S.select([S.DAILY], f"""
SELECT {S.DAILY_LIST} FROM daily WHERE day >= DATE '1998-06-15'"""))
def range_1y(t: Tables) -> DataFrame:
    as_of = dt.datetime.combine(DAILY_AS_OF, dt.time())
    return scan.daily_between(t.daily, timewin.range_start("1y", as_of).date())


@query("range_all", S.select([S.DAILY], f"SELECT {S.DAILY_LIST} FROM daily WHERE day >= DATE '1970-01-01'"))
def range_all(t: Tables) -> DataFrame:
    as_of = dt.datetime.combine(DAILY_AS_OF, dt.time())
    return scan.daily_between(t.daily, timewin.range_start("all", as_of).date())


@query("rollup_scan", S.select([S.DAILY], """
SELECT station_id, day, temp_avg, precip_total_mm, sunshine_hours FROM daily
WHERE day >= DATE '1998-01-01' AND day < DATE '1999-01-01'"""))
def rollup_scan(t: Tables) -> DataFrame:
    return scan.daily_between(t.daily, "1998-01-01", "1999-01-01").select(
        "station_id", "day", "temp_avg", "precip_total_mm", "sunshine_hours")


@query("recent_n_ascending", S.select([S.READINGS], """
SELECT station_id, observed_at, temp_c FROM readings
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) <= 200"""))
def recent_n_ascending(t: Tables) -> DataFrame:
    rows = t.readings.select("station_id", "observed_at", "temp_c")
    return scan.recent_n_ascending(rows, timewin.RAW_ROW_CAPS["today"])


@query("earliest_n", S.select([S.READINGS], """
SELECT station_id, observed_at, temp_c FROM readings
WHERE observed_at >= TIMESTAMP '2024-01-05 00:00:00' AND observed_at < TIMESTAMP '2024-01-25 00:00:00'
ORDER BY observed_at, station_id LIMIT 1500"""))
def earliest_n(t: Tables) -> DataFrame:
    rows = scan.readings_between(t.readings, "2024-01-05", "2024-01-25")
    return scan.earliest_n(rows.select("station_id", "observed_at", "temp_c"), timewin.RAW_ROW_CAPS["custom"])


_RANGES = f"""ranges AS (
  SELECT station_id, min(observed_at) AS min_at, max(observed_at) AS max_at FROM readings GROUP BY station_id),
rolled AS (SELECT station_id, min(day) AS daily_min FROM daily GROUP BY station_id)"""


@query("data_range", """
WITH seen AS (SELECT user_id AS station_id, min(ts) AS min_at, max(ts) AS max_at FROM events GROUP BY user_id),
rolled AS (SELECT o_custkey AS station_id, min(cast(o_orderdate AS date)) AS daily_min FROM orders GROUP BY o_custkey)
SELECT coalesce(seen.station_id, rolled.station_id) AS station_id, min_at, max_at, daily_min
FROM seen FULL JOIN rolled ON rolled.station_id = seen.station_id""")
def data_range(t: Tables) -> DataFrame:
    """Over the fleet, where many stations have rows of one kind only."""
    raw = t.table("events").select(F.col("user_id").alias("station_id"), F.col("ts").alias("observed_at"))
    daily = t.table("orders").select(F.col("o_custkey").alias("station_id"), F.col("o_orderdate").cast("date").alias("day"))
    return scan.data_range(raw, daily)


def _local_date(ts: str) -> str:
    return f"cast(timezone(coalesce(s.timezone, 'UTC'), timezone('UTC', {ts})) AS date)"


@query("period_bounds", S.select([S.STATIONS, S.READINGS, S.DAILY, _RANGES], f"""
SELECT s.station_id, CASE WHEN min_at IS NOT NULL
    THEN greatest({_local_date('min_at')}, {_local_date(S.AS_OF)} - 90) END AS day_floor,
  coalesce(daily_min, {_local_date('min_at')}) AS period_floor, {_local_date('max_at')} AS ceiling
FROM stations s LEFT JOIN ranges ON ranges.station_id = s.station_id LEFT JOIN rolled ON rolled.station_id = s.station_id
WHERE min_at IS NOT NULL OR daily_min IS NOT NULL"""))
def period_bounds(t: Tables) -> DataFrame:
    return scan.period_bounds(scan.data_range(t.readings, t.daily), t.stations, AS_OF)


_SENSORS = ["temp_c", "temp_indoor_c", "humidity_indoor", "windchill_c", "heat_index_c", "solar_radiation"]


@query("sensor_availability", S.select([S.READINGS], f"""
SELECT station_id, {', '.join(f'count({m}) > 0 AS has_{m}' for m in _SENSORS)} FROM readings GROUP BY station_id"""))
def sensor_availability(t: Tables) -> DataFrame:
    return scan.sensor_availability(t.readings, _SENSORS)


@query("circular_mean_wind", S.select([S.READINGS], f"""
SELECT station_id, {S.circ('wind_dir')} AS wind_dir, {S.circ_int('wind_dir')} AS wind_dir_int,
  {S.compass(S.circ('wind_dir'))} AS compass FROM readings GROUP BY station_id"""))
def circular_mean_wind(t: Tables) -> DataFrame:
    return buckets.wind_mean(t.readings)


_SIX = "date_trunc('day', local_ts) + to_hours(cast(hour(local_ts) // 6 * 6 AS integer))"
_SIX_LABELS = """strftime(bucket_start, '%H:00') AS label,
  CASE WHEN hour(bucket_start) = 0 THEN strftime(bucket_start, '%a %-d') END AS day_label,
  strftime(bucket_start, '%a %-d, %H:00') AS full_label"""


@query("bucket_6h", S.select([*BASE, f"""six AS (
  SELECT station_id, {_SIX} AS bucket_start, {_means} FROM loc GROUP BY station_id, {_SIX})"""],
    f"SELECT *, {_SIX_LABELS} FROM six"))
def bucket_6h(t: Tables) -> DataFrame:
    return buckets.bucket_6h(t.readings, t.stations, METRICS)


@query("bucket_daily", S.select(BASE, f"""
SELECT station_id, local_day AS day, {_means}, strftime(local_day, '%b %-d') AS label
FROM loc GROUP BY station_id, local_day"""))
def bucket_daily(t: Tables) -> DataFrame:
    return buckets.bucket_daily(t.readings, t.stations, METRICS)


@query("daily_min_avg_max", S.select(BASE, f"""
SELECT station_id, local_day AS day, {S.jr('avg(temp_c)', 1)} AS "avg", min(temp_c) AS "min", max(temp_c) AS "max"
FROM loc WHERE temp_c IS NOT NULL GROUP BY station_id, local_day"""))
def daily_min_avg_max(t: Tables) -> DataFrame:
    return daily.daily_min_avg_max(t.readings, t.stations, "temp_c")


@query("hourly_wind_direction", S.select(BASE, f"""
SELECT station_id, date_trunc('hour', local_ts) AS hour_start, {S.circ_int('wind_dir')} AS direction,
  strftime(date_trunc('hour', local_ts), '%H:00') AS label
FROM loc WHERE wind_dir IS NOT NULL GROUP BY station_id, date_trunc('hour', local_ts)"""))
def hourly_wind_direction(t: Tables) -> DataFrame:
    return buckets.hourly_wind_direction(t.readings, t.stations)


@query("wind_rose", S.select([S.READINGS, """octants AS (
  SELECT * FROM (VALUES (0,'N'),(1,'NE'),(2,'E'),(3,'SE'),(4,'S'),(5,'SW'),(6,'W'),(7,'NW')) o(sector, direction)),
seen AS (SELECT station_id, cast(floor(wind_dir / 45.0 + 0.5) AS integer) % 8 AS sector FROM readings
  WHERE wind_dir IS NOT NULL),
total AS (SELECT station_id, count(*) AS n FROM seen GROUP BY station_id)"""], f"""
SELECT total.station_id, octants.sector, octants.direction,
  {S.jr('cast(count(seen.station_id) AS double) / max(total.n) * 100', 1)} AS share_pct
FROM total CROSS JOIN octants
LEFT JOIN seen ON seen.station_id = total.station_id AND seen.sector = octants.sector
GROUP BY total.station_id, octants.sector, octants.direction"""))
def wind_rose(t: Tables) -> DataFrame:
    return buckets.wind_rose(t.readings)


@query("compass_16", S.select([S.READINGS], f"""
SELECT event_id, wind_dir, {S.compass('wind_dir')} AS compass FROM readings"""))
def compass_16(t: Tables) -> DataFrame:
    return t.measured_events.select("event_id", "wind_dir", compass(F.col("wind_dir")).alias("compass"))


@query("sunshine_daily_count", S.select(BASE, f"""
SELECT station_id, local_day AS day, {S.SUN_COUNT} AS sunshine_hours FROM loc GROUP BY station_id, local_day"""))
def sunshine_daily_count(t: Tables) -> DataFrame:
    return daily.sunshine_daily_count(t.readings, t.stations)


@query("sunshine_elapsed", S.select([S.READINGS, S.credits("readings", "station_id"), f"""sun AS (
  SELECT station_id, {S.SUN_HOURS} AS sunshine_hours FROM credits GROUP BY station_id)"""], """
SELECT k.station_id, sunshine_hours FROM (SELECT DISTINCT station_id FROM readings) k
LEFT JOIN sun ON sun.station_id = k.station_id"""))
def sunshine_elapsed(t: Tables) -> DataFrame:
    return sunshine.sunshine_elapsed(t.readings)


_BY_DAY = [*BASE, S.credits("loc", "station_id, local_day"), f"""sun AS (
  SELECT station_id, local_day, {S.SUN_HOURS} AS sunshine_hours FROM credits GROUP BY station_id, local_day),
days AS (
  SELECT k.station_id, k.local_day AS day, sunshine_hours
  FROM (SELECT DISTINCT station_id, local_day FROM loc) k
  LEFT JOIN sun ON sun.station_id = k.station_id AND sun.local_day = k.local_day)"""]


@query("sunshine_by_day", S.select(_BY_DAY, "SELECT *, strftime(day, '%b %-d') AS label FROM days"))
def sunshine_by_day(t: Tables) -> DataFrame:
    return sunshine.sunshine_by_day(t.readings, t.stations)


@query("sunshine_today", S.select(_BY_DAY, """
SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY day DESC) = 1"""))
def sunshine_today(t: Tables) -> DataFrame:
    return sunshine.sunshine_latest_day(t.readings, t.stations)


_SERIES = [*BASE, S.credits("loc", "station_id"), f"""series AS (
  SELECT station_id, observed_at, local_day AS day, {S.jr('cast(credit AS double) / 3600000000', 2)} AS hours,
    strftime(local_ts, '%H:%M') AS label FROM credits)"""]


@query("sunshine_series_raw", S.select(_SERIES, "SELECT * FROM series"))
def sunshine_series_raw(t: Tables) -> DataFrame:
    return sunshine.sunshine_series_raw(t.readings, t.stations)


@query("sunshine_series_6h", S.select([*BASE, S.credits("loc", "station_id"), f"""six AS (
  SELECT station_id, {_SIX} AS bucket_start, {S.jr('cast(sum(credit) AS double) / 3600000000', 1)} AS hours
  FROM credits GROUP BY station_id, {_SIX})"""], f"SELECT *, {_SIX_LABELS} FROM six"))
def sunshine_series_6h(t: Tables) -> DataFrame:
    return sunshine.sunshine_series_6h(t.readings, t.stations)


@query("sunshine_cumulative_6h", S.select([*BASE, S.credits("loc", "station_id"), f"""six AS (
  SELECT station_id, {_SIX} AS bucket_start, {S.jr('cast(sum(credit) AS double) / 3600000000', 1)} AS hours
  FROM credits GROUP BY station_id, {_SIX}), labelled AS (SELECT *, {_SIX_LABELS} FROM six)"""], f"""
SELECT station_id, cast(bucket_start AS date) AS day, bucket_start, label, day_label, full_label,
  {S.jr("""cast(sum(cast(hours AS decimal(12,1))) OVER (PARTITION BY station_id, cast(bucket_start AS date)
    ORDER BY bucket_start) AS double)""", 1)} AS cumulative
FROM labelled"""))
def sunshine_cumulative_6h(t: Tables) -> DataFrame:
    return sunshine.sunshine_cumulative_6h(t.readings, t.stations)


@query("sunshine_today_daily", S.select([S.DAILY], """
SELECT station_id, day, sunshine_hours FROM daily
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY day DESC) = 1"""))
def sunshine_today_daily(t: Tables) -> DataFrame:
    return sunshine.sunshine_latest_daily(t.daily)


@query("sunshine_cumulative", S.select([*_SERIES, """run AS (
  SELECT *, sum(cast(hours AS decimal(12,2))) OVER (PARTITION BY station_id, day ORDER BY observed_at) AS total
  FROM series)"""], f"SELECT station_id, day, observed_at, label, {S.jr('total', 1)} AS cumulative FROM run"))
def sunshine_cumulative(t: Tables) -> DataFrame:
    return sunshine.sunshine_cumulative(t.readings, t.stations)


@query("local_parts", S.select(BASE, """
SELECT event_id, cast(year(local_ts) AS integer) AS y, cast(month(local_ts) AS integer) AS mo,
  cast(day(local_ts) AS integer) AS d, cast(hour(local_ts) AS integer) AS h, local_day FROM loc"""))
def local_parts(t: Tables) -> DataFrame:
    ts = F.col("local_ts")
    return scan.with_local_time(t.measured_events, t.stations).select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("d"),
        F.hour(ts).alias("h"), "local_day")


_AGE = f"(epoch_us({S.AS_OF}) - epoch_us(observed_at)) / 60000000.0"


@query("relative_time", S.select([S.READINGS, f"""m AS (
  SELECT event_id, cast(floor({S.dbl(_AGE)} + 0.5) AS bigint) AS mins FROM readings),
h AS (SELECT *, cast(floor(mins / 60.0 + 0.5) AS bigint) AS hrs FROM m),
d AS (SELECT *, cast(floor(hrs / 24.0 + 0.5) AS bigint) AS days FROM h)"""], """
SELECT event_id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN mins || ' min ago'
  WHEN hrs < 24 THEN hrs || ' hr ago' WHEN days = 1 THEN '1 day ago' ELSE days || ' days ago' END AS age FROM d"""))
def relative_time(t: Tables) -> DataFrame:
    return t.measured_events.select("event_id", clock.relative_label(F.col("observed_at"), AS_OF).alias("age"))


_ROUNDED = "value / 10 - 5"


@query("round_modes", S.select([S.READINGS], f"""
SELECT event_id, {S.jr(_ROUNDED, 1)} AS js_1, {S.jr(_ROUNDED, 2)} AS js_2,
  {S.pr(_ROUNDED, 1)} AS pg_1, {S.pr(_ROUNDED, 2)} AS pg_2 FROM readings"""))
def round_modes(t: Tables) -> DataFrame:
    from fieldobs.functions.rounding import js_round, pg_round

    x = F.col("value") / 10 - 5
    return t.measured_events.select("event_id", js_round(x, 1).alias("js_1"), js_round(x, 2).alias("js_2"),
                                    pg_round(x, 1).alias("pg_1"), pg_round(x, 2).alias("pg_2"))


@query("feels_like", S.select([S.READINGS], "SELECT event_id, feels_like_c FROM readings"))
def feels_like(t: Tables) -> DataFrame:
    return t.measured_events.select("event_id", "feels_like_c")


@query("latest_per_station", S.select([S.READINGS, S.latest(S.READING_COLUMNS)], "SELECT * FROM latest"))
def latest_per_station(t: Tables) -> DataFrame:
    return latest.latest_per_station(t.readings, AS_OF)


@query("readings_daily_sql", S.select([*BASE, S.rollup("observed_at >= TIMESTAMP '2024-01-10 07:30:00'")],
                                      f"SELECT {S.DAILY_LIST} FROM rollup WHERE station_id = 7"))
def readings_daily_sql(t: Tables) -> DataFrame:
    """One station's days by the SQL table function."""
    sqlfunctions.register(t.spark, t.readings, t.stations, ("sql_readings", "sql_stations"))
    return t.spark.sql("SELECT 7L AS station_id, * FROM readings_daily(7, TIMESTAMP_NTZ'2024-01-10 07:30:00')").select(*DAILY_COLUMNS)


@query("rollup_days_sql", S.select([*BASE, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def rollup_days_sql(t: Tables) -> DataFrame:
    sqlfunctions.register(t.spark, t.readings, t.stations, ("sql_readings", "sql_stations"))
    return t.spark.sql("SELECT * FROM rollup_days(TIMESTAMP_NTZ'1970-01-01 00:00:00')").select(*DAILY_COLUMNS)


@query("partials_6h", S.select([*BASE, f"""six AS (
  SELECT station_id, {_SIX} AS bucket_start, {_means} FROM loc GROUP BY station_id, {_SIX})"""],
    f"SELECT *, {_SIX_LABELS} FROM six"))
def partials_6h(t: Tables) -> DataFrame:
    """Six-hour chart points from quarter-hour partials."""
    return buckets.bucket_6h_from_partials(daily.quarter_hour_partials(t.readings), t.stations, METRICS)


@query("partials_daily", S.select(BASE, f"""
SELECT station_id, local_day AS day, {_means}, strftime(local_day, '%b %-d') AS label
FROM loc GROUP BY station_id, local_day"""))
def partials_daily(t: Tables) -> DataFrame:
    return buckets.bucket_daily_from_partials(daily.quarter_hour_partials(t.readings), t.stations, METRICS)


@query("partials_hourly_wind", S.select(BASE, f"""
SELECT station_id, date_trunc('hour', local_ts) AS hour_start, {S.circ_int('wind_dir')} AS direction,
  strftime(date_trunc('hour', local_ts), '%H:00') AS label
FROM loc WHERE wind_dir IS NOT NULL GROUP BY station_id, date_trunc('hour', local_ts)"""))
def partials_hourly_wind(t: Tables) -> DataFrame:
    return buckets.hourly_wind_from_partials(daily.quarter_hour_partials(t.readings), t.stations)

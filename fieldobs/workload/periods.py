"""Queries that compare periods and stations, and that summarise windows in words."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import text
from fieldobs.operators import compare, scan, summary
from fieldobs.operators.daily import daily_rollup
from fieldobs.plans import timewin
from fieldobs.workload import sql as S
from fieldobs.workload.adapters import AS_OF, DAILY_AS_OF, Tables
from fieldobs.workload.registry import query

MONTHS = timewin.preset_periods("momYoY", DAILY_AS_OF)
YEARS = timewin.preset_periods("yoy", DAILY_AS_OF)
DAY_A, DAY_B = dt.date(2024, 1, 20), dt.date(2024, 1, 21)
SIDES = ("a", "b")


# For the SQL side, written out rather than taken from the library.
SQL_MONTHS = (("1999-06-01", "1999-07-01"), ("1998-06-01", "1998-07-01"))
SQL_YEARS = (("1999-01-01", "2000-01-01"), ("1998-01-01", "1999-01-01"))
SQL_DAYS = (("2024-01-20", "2024-01-21"), ("2024-01-21", "2024-01-22"))
# Metric: raw column, figure of a period, figure of a day.
SQL_METRICS = {
    "temp_avg": ("temp_c", "avg", "avg"), "precip_total_mm": ("precip_total_mm", "sum", "max"),
    "humidity": ("humidity", "avg", "avg"), "wind_speed_kph": ("wind_speed_kph", "avg", "avg"),
    "pressure_mb": ("pressure_mb", "avg", "avg"), "uv": ("uv", "avg", "avg"),
    "solar_radiation": ("solar_radiation", "avg", "avg"), "sunshine_hours": (None, "sum", None),
    "humidity_indoor": ("humidity_indoor", "avg", "avg"),
}
SQL_RAW_METRICS = {m: raw for m, raw in SQL_METRICS.items() if raw[0]}
SQL_STATION_TABLE = {"temp_avg": "avg", "temp_max": "max", "temp_min": "min", "precip_total_mm": "sum",
                     "sunshine_hours": "sum", "wind_speed_kph": "avg", "humidity": "avg", "pressure_mb": "avg"}


def _in(period: tuple[str, str], day: str = "day") -> str:
    return f"({day} >= DATE '{period[0]}' AND {day} < DATE '{period[1]}')"


def _sides(pair, source: str = "daily", day: str = "day") -> str:
    """Rows of both periods, tagged."""
    return "sides AS (" + " UNION ALL ".join(
        f"SELECT *, '{side}' AS side, DATE '{p[0]}' AS start FROM {source} WHERE {_in(p, day)}"
        for side, p in zip(SIDES, pair)) + ")"


def _on(side: str, value: str) -> str:
    return f"CASE WHEN side = '{side}' THEN {value} END"


_RAW = [S.STATIONS, S.READINGS, S.LOCAL, _sides(SQL_DAYS, "loc", "local_day")]


def _aligned(metric: str, pair_side: str) -> str:
    return f"{pair_side}.{metric} AS {metric}_{pair_side}"


@query("compare_periods_aligned", S.select([S.DAILY, *[f"""{side} AS (
  SELECT *, date_diff('day', DATE '{p[0]}', day) + 1 AS idx FROM daily WHERE {_in(p)})"""
    for side, p in zip(SIDES, SQL_MONTHS)]], f"""
SELECT coalesce(a.station_id, b.station_id) AS station_id, cast(coalesce(a.idx, b.idx) AS integer) AS idx,
  {', '.join(_aligned(m, s) for m in SQL_METRICS for s in SIDES)}
FROM a FULL JOIN b ON a.station_id = b.station_id AND a.idx = b.idx"""))
def compare_periods_aligned(t: Tables) -> DataFrame:
    return compare.compare_periods_aligned(t.daily, *MONTHS)


@query("compare_days_hourly", S.select(_RAW, f"""
SELECT station_id, cast(hour(local_ts) AS integer) AS idx,
  {', '.join(f"{S.jr(f'avg({_on(s, raw)})', 1)} AS {m}_{s}"
             for m, (raw, _, _) in SQL_RAW_METRICS.items() for s in SIDES)}
FROM sides GROUP BY station_id, hour(local_ts)"""))
def compare_days_hourly(t: Tables) -> DataFrame:
    return compare.compare_days_hourly(t.readings, t.stations, DAY_A, DAY_B)


def _deltas(stats: str, metrics) -> str:
    return f"SELECT *, {', '.join(f'{S.jr(f"{m}_a - {m}_b", 1)} AS {m}_delta' for m in metrics)} FROM {stats}"


@query("compare_period_stats", S.select([S.DAILY, _sides(SQL_YEARS), f"""stats AS (
  SELECT station_id, {', '.join(f"{S.jr(f'{fold}({_on(s, m)})', 1)} AS {m}_{s}"
                                for m, (_, fold, _) in SQL_METRICS.items() for s in SIDES)}
  FROM sides GROUP BY station_id)"""], _deltas("stats", SQL_METRICS)))
def compare_period_stats(t: Tables) -> DataFrame:
    return compare.compare_period_stats(t.daily, *YEARS)


@query("compare_day_stats", S.select([*_RAW, f"""stats AS (
  SELECT station_id, {', '.join(f"{S.jr(f'{fold}({_on(s, raw)})', 1)} AS {m}_{s}"
                                for m, (raw, _, fold) in SQL_RAW_METRICS.items() for s in SIDES)}
  FROM sides GROUP BY station_id)"""], _deltas("stats", SQL_RAW_METRICS)))
def compare_day_stats(t: Tables) -> DataFrame:
    return compare.compare_day_stats(t.readings, t.stations, DAY_A, DAY_B)


def _requested(t: Tables) -> DataFrame:
    """Users as requested ids: most of them name no station."""
    return t.table("events").select(F.col("user_id").alias("station_id")).distinct()


@query("compare_stations", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup(
    f"observed_at >= {S.AS_OF} - INTERVAL 30 DAY AND observed_at <= {S.AS_OF}"), "wanted AS (SELECT DISTINCT user_id AS station_id FROM events)"], """
SELECT w.station_id, coalesce(s.name, cast(w.station_id AS varchar)) AS name, day, temp_avg, precip_total_mm,
  sunshine_hours
FROM wanted w LEFT JOIN stations s ON s.station_id = w.station_id LEFT JOIN rollup r ON r.station_id = w.station_id"""))
def compare_stations(t: Tables) -> DataFrame:
    start = timewin.comparison_range_start("30d", AS_OF)
    series = daily_rollup(scan.readings_since(t.readings, start, AS_OF), t.stations)
    return compare.compare_stations(_requested(t), t.stations, series,
                                    ["temp_avg", "precip_total_mm", "sunshine_hours"])


@query("compare_stations_table", S.select([S.DAILY], f"""
SELECT station_id, {', '.join(f"{S.jr(f'{fold}({m})', 1)} AS {m}" for m, fold in SQL_STATION_TABLE.items())}
FROM daily GROUP BY station_id"""))
def compare_stations_table(t: Tables) -> DataFrame:
    return compare.compare_stations_table(t.daily)


_ALL_IDS = list(range(25))


@query("multi_station_pivot", S.select([S.DAILY], f"""
SELECT day, {', '.join(f'max(temp_avg) FILTER (station_id = {i}) AS s{i}' for i in _ALL_IDS)} FROM daily GROUP BY day"""))
def multi_station_pivot(t: Tables) -> DataFrame:
    return compare.multi_station_pivot(t.daily, _ALL_IDS, "temp_avg")


@query("distinct_days", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.DAILY], """
SELECT day FROM daily UNION SELECT local_day FROM loc"""))
def distinct_days(t: Tables) -> DataFrame:
    local = scan.with_local_time(t.readings, t.stations).select(F.col("local_day").alias("day"))
    return compare.distinct_days(t.daily, local)


@query("temp_band", S.select([S.DAILY], """
SELECT station_id, day, temp_avg, temp_min AS band_low, temp_max AS band_high FROM daily"""))
def temp_band(t: Tables) -> DataFrame:
    return compare.temp_band(t.daily).select(
        "station_id", "day", "temp_avg", F.get("band", F.lit(0)).alias("band_low"),
        F.get("band", F.lit(1)).alias("band_high"))


_COMPARE = [S.DAILY, _sides(SQL_YEARS), f"""c AS (
  SELECT station_id, {', '.join(f'''count({_on(s, '1')}) AS days_{s}, avg({_on(s, 'temp_avg')}) AS temp_{s},
    coalesce(sum({_on(s, 'precip_total_mm')}), 0) AS rain_{s}, avg({_on(s, 'wind_speed_kph')}) AS wind_{s}'''
                                for s in SIDES)} FROM sides GROUP BY station_id),
stats AS (SELECT station_id, days_a, days_b,
  {', '.join(f'{S.jr(f"{m}_{s}", 1)} AS {m}_{s}' for m in ('temp', 'rain', 'wind') for s in SIDES)},
  {', '.join(f'{S.jr(f"{m}_a - {m}_b", 1)} AS {m}_diff' for m in ('temp', 'rain', 'wind'))} FROM c)"""]


@query("compare_summary_stats", S.select(_COMPARE, "SELECT * FROM stats"))
def compare_summary_stats(t: Tables) -> DataFrame:
    return compare.compare_summary_stats(t.daily, *YEARS)


def _lines(stats: DataFrame) -> DataFrame:
    return stats.withColumn("lines", F.concat_ws("\n", "lines"))


def _said(*sentences: str) -> str:
    return f"concat_ws(chr(10), {', '.join(sentences)})"


_A, _B = "1999", "1998"


@query("summary_comparison_text", S.select(_COMPARE, f"""
SELECT station_id, {_said(f'''
  CASE WHEN temp_a IS NOT NULL AND temp_b IS NOT NULL THEN '{_A} averaged ' || {S.num('temp_a')} || '°C — ' ||
    CASE WHEN abs(temp_diff) < 0.1 THEN 'about the same temperature as {_B}'
      ELSE {S.num('abs(temp_diff)')} || '°C ' || CASE WHEN temp_diff > 0 THEN 'warmer' ELSE 'cooler' END
        || ' than {_B}' END || ' (' || {S.num('temp_b')} || '°C).'
    WHEN temp_a IS NOT NULL THEN '{_A} averaged ' || {S.num('temp_a')} || '°C (no comparison data for {_B} yet).' END''', f'''
  CASE WHEN days_a > 0 AND days_b > 0 THEN 'Rainfall totalled ' || {S.num('rain_a')} || ' mm vs ' || {S.num('rain_b')}
      || ' mm — ' || CASE WHEN abs(rain_diff) < 0.5 THEN 'a similar amount'
        ELSE {S.num('abs(rain_diff)')} || ' mm ' || CASE WHEN rain_diff > 0 THEN 'more' ELSE 'less' END END || '.'
    WHEN days_a > 0 THEN 'Rainfall totalled ' || {S.num('rain_a')} || ' mm.' END''', f'''
  CASE WHEN wind_a IS NOT NULL AND wind_b IS NOT NULL THEN 'Average wind ' || {S.num('wind_a')} || ' km/h vs '
    || {S.num('wind_b')} || ' km/h — ' || CASE WHEN abs(wind_diff) < 0.5 THEN 'similar winds'
      ELSE CASE WHEN wind_diff > 0 THEN 'windier' ELSE 'calmer' END || ' on average' END || '.' END''')} AS lines
FROM stats"""))
def summary_comparison_text(t: Tables) -> DataFrame:
    stats = compare.compare_summary_stats(t.daily, *YEARS)
    return _lines(compare.summary_comparison_text(stats, _A, _B))


def _record(metric: str, name: str, order: str) -> str:
    return f"""{name}_rec AS (SELECT station_id, {metric} AS {name}, day AS {name}_day FROM days
  WHERE {metric} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY {metric} {order}, day) = 1)"""


_YEAR = YEARS[1]
_SUMMARY = [S.DAILY, f"days AS (SELECT * FROM daily WHERE {_in(SQL_YEARS[1])})",
            _record("temp_max", "warmest", "DESC"), _record("temp_min", "coldest", "ASC"),
            _record("wind_gust_kph", "gust", "DESC"), f"""base AS (
  SELECT station_id, {S.jr('avg(temp_avg)', 1)} AS temp_mean,
    {S.jr('coalesce(sum(precip_total_mm), 0)', 1)} AS rain_total, count(*) FILTER (precip_total_mm > 0.2) AS wet_days,
    {S.jr('sum(sunshine_hours)', 1)} AS sun_total, count(sunshine_hours) AS sun_days FROM days GROUP BY station_id),
stats AS (
  SELECT b.*, {S.jr('sun_total / nullif(sun_days, 0)', 1)} AS sun_per_day, warmest, warmest_day, coldest, coldest_day,
    gust, gust_day
  FROM base b LEFT JOIN warmest_rec w ON w.station_id = b.station_id
  LEFT JOIN coldest_rec c ON c.station_id = b.station_id LEFT JOIN gust_rec g ON g.station_id = b.station_id)"""]


def _year_rows(t: Tables) -> DataFrame:
    return scan.daily_between(t.daily, _YEAR.start, _YEAR.end)


@query("warmest_day", S.select(_SUMMARY, """
SELECT station_id, warmest_day AS day, warmest AS temp_max FROM warmest_rec"""))
def warmest_day(t: Tables) -> DataFrame:
    return summary.extreme_day(_year_rows(t), "temp_max")


@query("summary_daily_stats", S.select(_SUMMARY, "SELECT * FROM stats"))
def summary_daily_stats(t: Tables) -> DataFrame:
    return summary.summary_daily_stats(_year_rows(t))


def _day(col: str) -> str:
    return f"strftime({col}, '%-d %b')"


@query("summary_daily_text", S.select(_SUMMARY, f"""
SELECT station_id, {_said(
    f"'Averaged ' || {S.num('temp_mean')} || '°C over 1998. Warmest ' || {S.num('warmest')} || '°C (' || "
    f"{_day('warmest_day')} || '), coldest ' || {S.num('coldest')} || '°C (' || {_day('coldest_day')} || ').'",
    f"CASE WHEN wet_days = 0 THEN 'No measurable rain.' ELSE {S.num('rain_total')} || ' mm of rain across ' "
    f"|| wet_days || CASE WHEN wet_days = 1 THEN ' day.' ELSE ' days.' END END",
    f"'Windiest day peaked at ' || {S.num(S.jr('gust', 1))} || ' km/h (' || {_day('gust_day')} || ').'",
    f"{S.num('sun_total')} || ' hours of sunshine, averaging ' || {S.num('sun_per_day')} || ' h/day.'")} AS lines
FROM stats"""))
def summary_daily_text(t: Tables) -> DataFrame:
    return _lines(summary.summary_daily_text(summary.summary_daily_stats(_year_rows(t)), _YEAR.label))


_WEEK = ("2024-01-15", "2024-01-22")


def _week_rows(t: Tables) -> DataFrame:
    return scan.readings_between(t.readings, *_WEEK)


_GAUGES = f"""gauges AS (
  SELECT station_id, local_day, greatest(max(precip_total_mm), 0) AS gauge FROM loc
  WHERE precip_total_mm IS NOT NULL GROUP BY station_id, local_day),
rain AS (SELECT station_id, {S.jr('sum(gauge)', 1)} AS rain_total, count(*) FILTER (gauge > 0.2) AS wet_days,
  count(*) AS gauge_days FROM gauges GROUP BY station_id)"""
_TREND = f"""ends AS (
  SELECT station_id, count(pressure_mb) AS n, min_by(pressure_mb, observed_at) FILTER (pressure_mb IS NOT NULL) AS a,
    max_by(pressure_mb, observed_at) FILTER (pressure_mb IS NOT NULL) AS z FROM readings GROUP BY station_id),
changes AS (SELECT station_id, CASE WHEN n >= 2 THEN {S.jr('z - a', 1)} END AS pressure_change FROM ends),
trend AS (SELECT *, CASE WHEN abs(pressure_change) < 1 THEN 'steady' WHEN pressure_change > 0 THEN 'rising'
  WHEN pressure_change < 0 THEN 'falling' END AS trend FROM changes)"""


@query("rainfall_window", S.select([S.STATIONS, S.READINGS, S.LOCAL, _GAUGES],
                                   "SELECT station_id, rain_total, wet_days FROM rain"))
def rainfall_window(t: Tables) -> DataFrame:
    return summary.rainfall_window(t.readings, t.stations)


@query("pressure_trend", S.select([S.READINGS, _TREND], "SELECT * FROM trend"))
def pressure_trend(t: Tables) -> DataFrame:
    return summary.pressure_trend(t.readings)


def _moment(name: str, order: str) -> str:
    return f"""{name}_m AS (SELECT station_id, temp_c AS {name}, local_ts AS {name}_at FROM loc WHERE temp_c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY temp_c {order}, observed_at) = 1)"""


_WEEK_READINGS = S.READINGS.replace("FROM ev)", f"""FROM ev
  WHERE ts >= TIMESTAMP '{_WEEK[0]} 00:00:00' AND ts < TIMESTAMP '{_WEEK[1]} 00:00:00')""")
_PERIOD = [S.STATIONS, _WEEK_READINGS, S.LOCAL, _GAUGES, _TREND, _moment("high", "DESC"), _moment("low", "ASC"),
           S.credits("readings", "station_id"), f"""sun AS (
  SELECT station_id, {S.SUN_HOURS} AS sunshine_hours FROM credits GROUP BY station_id),
base AS (SELECT station_id, {S.jr('avg(temp_c)', 1)} AS temp_mean, {S.jr('max(wind_gust_kph)', 1)} AS peak_gust
  FROM readings GROUP BY station_id),
stats AS (
  SELECT b.station_id, temp_mean, rain_total, coalesce(wet_days, 0) AS wet_days, coalesce(gauge_days, 0) AS gauge_days,
    peak_gust, pressure_change, trend, high, high_at, low, low_at, sunshine_hours
  FROM base b LEFT JOIN rain r ON r.station_id = b.station_id LEFT JOIN trend t ON t.station_id = b.station_id
  LEFT JOIN high_m h ON h.station_id = b.station_id LEFT JOIN low_m l ON l.station_id = b.station_id
  LEFT JOIN sun s ON s.station_id = b.station_id)"""]


@query("summary_period_stats", S.select(_PERIOD, "SELECT * FROM stats"))
def summary_period_stats(t: Tables) -> DataFrame:
    return summary.summary_period_stats(_week_rows(t), t.stations)


_AT = "'%a %H:%M'"


@query("summary_period_text", S.select(_PERIOD, f"""
SELECT station_id, {_said(
    f"'Average ' || {S.num('temp_mean')} || '°C in the week. High of ' || {S.num('high')} || '°C (' || "
    f"strftime(high_at, {_AT}) || '), low of ' || {S.num('low')} || '°C (' || strftime(low_at, {_AT}) || ').'",
    f"CASE WHEN gauge_days > 0 THEN CASE WHEN wet_days = 0 THEN 'No measurable rain.' ELSE {S.num('rain_total')} "
    f"|| ' mm of rain across ' || wet_days || CASE WHEN wet_days = 1 THEN ' wet day.' ELSE ' wet days.' END END END",
    f"'Peak gust ' || {S.num('peak_gust')} || ' km/h.'",
    f"{S.num('sunshine_hours')} || CASE WHEN sunshine_hours = 1 THEN ' hour' ELSE ' hours' END || ' of sunshine.'",
    f"'Pressure ' || trend || CASE WHEN abs(pressure_change) >= 1 THEN ' (' || CASE WHEN pressure_change > 0 THEN '+' "
    f"ELSE '' END || {S.num('pressure_change')} || ' hPa)' ELSE '' END || '.'")} AS lines
FROM stats"""))
def summary_period_text(t: Tables) -> DataFrame:
    stats = summary.summary_period_stats(_week_rows(t), t.stations)
    return _lines(summary.summary_period_text(stats, "the week"))


_DAYS_SEEN = "d AS (SELECT DISTINCT cast(o_orderdate AS date) AS day FROM orders)"


def _days_seen(t: Tables) -> DataFrame:
    return t.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


def _date(x: str) -> str:
    return f"cast({x} AS date)"


@query("period_windows", S.select([_DAYS_SEEN], f"""
SELECT day, {_date('day + 1')} AS day_end, strftime(day, '%A %-d %B') AS day_label,
  {_date("date_trunc('week', day)")} AS week_start, {_date("date_trunc('week', day) + INTERVAL 7 DAY")} AS week_end,
  'Week of ' || strftime(date_trunc('week', day), '%-d %B') AS week_label,
  {_date("date_trunc('month', day)")} AS month_start, {_date("date_trunc('month', day) + INTERVAL 1 MONTH")} AS month_end,
  strftime(day, '%B %Y') AS month_label,
  {_date("date_trunc('year', day)")} AS year_start, {_date("date_trunc('year', day) + INTERVAL 1 YEAR")} AS year_end,
  strftime(day, '%Y') AS year_label,
  cast(date_diff('day', date_trunc('month', day), day) + 1 AS integer) AS day_of_month FROM d"""))
def period_windows(t: Tables) -> DataFrame:
    day, w = F.col("day"), timewin
    week, month, year = w.week_start(day), w.month_start(day), w.year_start(day)
    return _days_seen(t).select(
        day, F.date_add(day, 1).alias("day_end"), w.day_label(day).alias("day_label"),
        week.alias("week_start"), F.date_add(week, 7).alias("week_end"), w.week_label(week).alias("week_label"),
        month.alias("month_start"), w.next_month(month).alias("month_end"), w.month_label(month).alias("month_label"),
        year.alias("year_start"), w.next_month(year, 12).alias("year_end"),
        F.date_format(year, "yyyy").alias("year_label"), w.day_of_period(day, month).alias("day_of_month"))


@query("preset_windows", S.select([_DAYS_SEEN, """p AS (
  SELECT day, date_trunc('month', day) AS m, date_trunc('year', day) AS y FROM d)"""], f"""
SELECT day, {_date('m')} AS a_from, {_date('m + INTERVAL 1 MONTH')} AS a_to, strftime(m, '%B %Y') AS a_label,
  {_date('m - INTERVAL 1 MONTH')} AS mom_from, {_date('m')} AS mom_to,
  strftime(m - INTERVAL 1 MONTH, '%B %Y') AS mom_label,
  {_date('m - INTERVAL 12 MONTH')} AS mom_yoy_from, {_date('m - INTERVAL 11 MONTH')} AS mom_yoy_to,
  strftime(m - INTERVAL 12 MONTH, '%B %Y') AS mom_yoy_label,
  {_date('y')} AS year_from, {_date('y - INTERVAL 1 YEAR')} AS yoy_from, {_date('y')} AS yoy_to,
  {_date('day - 1')} AS day_anchor, {_date('day - 7')} AS week_anchor,
  strftime(m - INTERVAL 1 MONTH, '%Y-%m') AS month_anchor FROM p"""))
def preset_windows(t: Tables) -> DataFrame:
    day, w = F.col("day"), timewin
    month, year = w.month_start(day), w.year_start(day)

    def shifted(start: Column, months: int) -> Column:
        return w.next_month(start, months)

    return _days_seen(t).select(
        day, month.alias("a_from"), shifted(month, 1).alias("a_to"), w.month_label(month).alias("a_label"),
        shifted(month, -1).alias("mom_from"), month.alias("mom_to"),
        w.month_label(shifted(month, -1)).alias("mom_label"),
        shifted(month, -12).alias("mom_yoy_from"), shifted(month, -11).alias("mom_yoy_to"),
        w.month_label(shifted(month, -12)).alias("mom_yoy_label"),
        year.alias("year_from"), shifted(year, -12).alias("yoy_from"), year.alias("yoy_to"),
        F.date_sub(day, 1).alias("day_anchor"), F.date_sub(day, 7).alias("week_anchor"),
        F.date_format(shifted(month, -1), "yyyy-MM").alias("month_anchor"))


@query("bucket_labels", S.select([S.STATIONS, S.READINGS, S.LOCAL], """
SELECT event_id, strftime(local_ts, '%H:00') AS hour_label, strftime(local_ts, '%a %-d') AS weekday_day,
  strftime(local_ts, '%a %H:%M') AS weekday_clock, strftime(local_day, '%b %-d') AS axis_day,
  strftime(local_day, '%b %-d, %y') AS axis_day_long, strftime(local_day, '%-d %b') AS day_short FROM loc"""))
def bucket_labels(t: Tables) -> DataFrame:
    ts, day = F.col("local_ts"), F.col("local_day")
    return scan.with_local_time(t.measured_events, t.stations).select(
        "event_id", text.hour_label(ts).alias("hour_label"), text.weekday_day(ts).alias("weekday_day"),
        text.weekday_clock(ts).alias("weekday_clock"), text.axis_day(day).alias("axis_day"),
        text.axis_day(day, long_range=True).alias("axis_day_long"), text.day_short(day).alias("day_short"))

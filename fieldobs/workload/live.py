"""Queries over the live view: today, staleness, regions, superlatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock, geo
from fieldobs.operators import latest, network, scan
from fieldobs.workload import sql as S
from fieldobs.workload.adapters import AS_OF, Tables
from fieldobs.workload.registry import query

_STATS = ["temp_high", "temp_low", "temp_mean", "wind_mean", "gust", "rain", "sunshine"]


def _cards(t: Tables) -> DataFrame:
    return latest.station_cards(t.stations, t.readings, AS_OF)


@query("station_list", S.select([S.FLEET], "SELECT * FROM fleet"))
def station_list(t: Tables) -> DataFrame:
    return scan.station_list(t.fleet)


@query("wind_1h_avg", S.select(S.LIVE, "SELECT * FROM hour_wind"))
def wind_1h_avg(t: Tables) -> DataFrame:
    return latest.wind_1h_avg(t.readings, AS_OF)


@query("today_stats", S.select(S.LIVE, "SELECT * FROM today_stats"))
def today_stats(t: Tables) -> DataFrame:
    return latest.today_stats(t.readings, t.stations, AS_OF)


@query("station_cards", S.select(S.LIVE, f"""
SELECT station_id, name, country, observed_at, temp_c, temp_indoor_c, precip_total_mm, avg_wind_kph,
  {', '.join(_STATS)}, summary FROM cards"""))
def station_cards(t: Tables) -> DataFrame:
    return _cards(t).select("station_id", "name", "country", "observed_at", "temp_c", "temp_indoor_c",
                            "precip_total_mm", "avg_wind_kph", *_STATS, "summary")


@query("station_headline", S.select(S.LIVE, "SELECT station_id, name, summary FROM cards"))
def station_headline(t: Tables) -> DataFrame:
    return _cards(t).select("station_id", "name", "summary")


@query("current_conditions", S.select([S.READINGS, S.latest(S.READING_COLUMNS)], f"""
SELECT station_id, observed_at,
  {S.joined(f"'Feels like ' || {S.num('feels_like_c')} || '°'", f"'Humidity ' || {S.num('humidity')} || '%'",
            f"'Wind ' || {S.num('wind_speed_kph')} || ' km/h ' || {S.compass('wind_dir')}")} AS conditions,
  coalesce(wind_speed_kph = 0, false) AS calm,
  CASE WHEN wind_speed_kph = 0 THEN 'Calm' ELSE {S.compass('wind_dir')} END AS bearing FROM latest"""))
def current_conditions(t: Tables) -> DataFrame:
    return latest.current_conditions(latest.latest_per_station(t.readings, AS_OF))


_LIMIT = "CASE WHEN source = 'weathercloud' THEN 120 ELSE 30 END"
_STALE = f"""newest AS (SELECT station_id, max(observed_at) AS newest FROM readings
  WHERE observed_at <= {S.AS_OF} GROUP BY station_id),
flagged AS (
  SELECT s.*, {_LIMIT} AS limit_minutes,
    coalesce(newest < {S.AS_OF} - to_minutes({_LIMIT}), true) AS stale
  FROM stations s LEFT JOIN newest n ON n.station_id = s.station_id)"""


@query("stale_stations", S.select([S.STATIONS, S.READINGS, _STALE], """
SELECT station_id, name, source, limit_minutes,
  name || ' (' || wunderground_id || '): no data in last ' || limit_minutes || ' minutes' AS issue
FROM flagged WHERE stale"""))
def stale_stations(t: Tables) -> DataFrame:
    return latest.stale_stations(t.stations, t.readings, AS_OF)


@query("network_health", S.select([S.STATIONS, S.READINGS, _STALE], """
SELECT count(*) AS stations, count(*) FILTER (stale) AS stale,
  CASE WHEN count(*) = 0 THEN 'error' WHEN count(*) FILTER (stale) = 0 THEN 'healthy' ELSE 'unhealthy' END AS status
FROM flagged"""))
def network_health(t: Tables) -> DataFrame:
    return latest.network_health(t.stations, t.readings, AS_OF)


_LISTED = "is_primary DESC, created_at, station_id"
_REGIONS = f"""regions AS (
  SELECT coalesce(country, 'Other') AS region, count(observed_at) AS station_count,
    {S.jr('avg(temp_mean) FILTER (observed_at IS NOT NULL)', 1)} AS avg_temp,
    {S.jr('max(rain) FILTER (observed_at IS NOT NULL)', 1)} AS max_rain
  FROM cards GROUP BY coalesce(country, 'Other')),
warm AS (SELECT coalesce(country, 'Other') AS region, name AS warmest, temp_high AS warmest_value FROM cards
  WHERE observed_at IS NOT NULL AND temp_high IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(country, 'Other') ORDER BY temp_high DESC, {_LISTED}) = 1),
wind AS (SELECT coalesce(country, 'Other') AS region, name AS windiest, wind_mean AS windiest_value FROM cards
  WHERE observed_at IS NOT NULL AND wind_mean IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(country, 'Other') ORDER BY wind_mean DESC, {_LISTED}) = 1),
region_stats AS (SELECT r.region, station_count, avg_temp, max_rain, warmest, warmest_value, windiest, windiest_value
  FROM regions r LEFT JOIN warm ON warm.region = r.region LEFT JOIN wind ON wind.region = r.region)"""


@query("region_stats", S.select([*S.LIVE, _REGIONS], "SELECT * FROM region_stats"))
def region_stats(t: Tables) -> DataFrame:
    return network.region_stats(_cards(t))


@query("region_headline", S.select([*S.LIVE, _REGIONS], f"""
SELECT region, {S.joined(
    "station_count || CASE WHEN station_count = 1 THEN ' station' ELSE ' stations' END",
    f"'avg ' || {S.num('avg_temp')} || '° (today)'",
    f"CASE WHEN station_count > 1 THEN 'warmest ' || warmest || ' ' || {S.num('warmest_value')} || '°' END",
    f"CASE WHEN windiest_value > 0 THEN 'windiest ' || windiest || ' ' || {S.num('windiest_value')} || ' km/h' END",
    f"CASE WHEN max_rain > 0 THEN 'up to ' || {S.num('max_rain')} || ' mm rain' END")} AS headline
FROM region_stats"""))
def region_headline(t: Tables) -> DataFrame:
    return network.region_headline(network.region_stats(_cards(t)))


def _pick(position: int, label: str, rank: str, shown: str, unit: str, condition: str = "true") -> str:
    return f"""SELECT {position} AS position, '{label}' AS label, {S.num(shown)} || '{unit}' AS value, station_id, sub
  FROM (SELECT *, name || ' · ' || coalesce(country, 'Other') AS sub FROM cards
    WHERE ({rank}) IS NOT NULL AND {condition}
    QUALIFY row_number() OVER (ORDER BY {rank} DESC, {_LISTED}) = 1)"""


@query("network_highlights", S.select(S.LIVE, " UNION ALL ".join([
    _pick(0, "Hottest", "temp_high", "temp_high", "°"),
    _pick(1, "Coolest", "-temp_low", "temp_low", "°"),
    _pick(2, "Sunniest", "sunshine", "sunshine", " h", "sunshine > 0"),
    _pick(3, "Wettest", "rain", S.jr("rain", 1), " mm", "rain > 0"),
    _pick(4, "Strongest gust", "gust", "gust", " km/h", "gust > 0"),
    _pick(5, "Biggest swing", S.settle("temp_high - temp_low"), S.jr("temp_high - temp_low", 1), "°"),
])))
def network_highlights(t: Tables) -> DataFrame:
    return network.network_highlights(_cards(t))


@query("warmest_region", S.select([*S.LIVE, f"""means AS (
  SELECT coalesce(country, 'Other') AS region, {S.jr('avg(temp_mean)', 1)} AS avg_temp,
    min(row(NOT is_primary, created_at, station_id)) AS seen
  FROM cards WHERE temp_mean IS NOT NULL GROUP BY coalesce(country, 'Other'))"""], """
SELECT region, avg_temp FROM means WHERE (SELECT count(*) FROM means) >= 2
ORDER BY avg_temp DESC, seen LIMIT 1"""))
def warmest_region(t: Tables) -> DataFrame:
    return network.warmest_region(_cards(t))


@query("region_order", S.select([S.FLEET, """groups AS (
  SELECT coalesce(country, 'Other') AS region, count(*) AS stations,
    coalesce(bool_or(is_primary AND country IS NOT NULL), false) AS home
  FROM fleet GROUP BY coalesce(country, 'Other'))"""], """
SELECT region, stations, CASE WHEN home THEN 0 WHEN region = 'Other' THEN 2 ELSE 1 END AS place FROM groups"""))
def region_order(t: Tables) -> DataFrame:
    return network.region_order(t.fleet)


@query("local_time", S.select([S.FLEET], f"""
SELECT station_id, CASE WHEN timezone IS NOT NULL
  THEN strftime(timezone(timezone, timezone('UTC', {S.AS_OF})), '%H:%M') END AS local_time FROM fleet"""))
def local_time(t: Tables) -> DataFrame:
    return t.fleet.select("station_id", clock.clock_label(F.col("timezone"), AS_OF).alias("local_time"))


def _edge(x: str) -> str:
    return f"cast(round(cast({x} AS decimal(30,10)), 5) AS decimal(12,5))"


@query("station_bbox", S.select([S.FLEET], f"""
SELECT station_id, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN concat_ws(',',
  {_edge('longitude - 0.02')}, {_edge('latitude - 0.02')}, {_edge('longitude + 0.02')}, {_edge('latitude + 0.02')})
  END AS bbox FROM fleet"""))
def station_bbox(t: Tables) -> DataFrame:
    return t.fleet.select("station_id", geo.bounding_box(F.col("latitude"), F.col("longitude")).alias("bbox"))


@query("local_midnight", S.select([S.STATIONS, S.READINGS, S.LOCAL], """
SELECT event_id, timezone('UTC', timezone(coalesce(timezone, 'UTC'), cast(local_day AS timestamp))) AS day_start
FROM loc"""))
def local_midnight(t: Tables) -> DataFrame:
    rows = scan.with_zone(t.measured_events.select("event_id", "station_id", "observed_at"), t.stations)
    return rows.select("event_id", clock.local_midnight(F.col("observed_at"), F.col("timezone")).alias("day_start"))

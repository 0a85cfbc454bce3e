"""SQL pieces shared by the registered queries: the adapters and expressions again, for DuckDB."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"

_ZONE = """CASE r_regionkey WHEN 0 THEN 'America/Toronto' WHEN 1 THEN 'Asia/Kolkata'
    WHEN 2 THEN 'Pacific/Auckland' WHEN 3 THEN 'Europe/London' END AS timezone"""


def _common(key: str) -> str:
    code = f"CASE WHEN {key} % 5 <> 4 THEN cast({key} + 900000 AS varchar) END"
    return f"""
    CASE WHEN {key} % 3 = 0 THEN 'WC-' || coalesce({code}, '?') ELSE 'ISTN' || {key} END AS wunderground_id,
    CASE WHEN {key} % 7 <> 0 THEN cast({key} * 131 % 18000 AS double) / 100 - 90 END AS latitude,
    CASE WHEN {key} % 7 <> 0 THEN cast({key} * 197 % 36000 AS double) / 100 - 180 END AS longitude,
    {key} = 0 AS is_primary,
    CASE WHEN {key} % 3 = 0 THEN 'weathercloud' ELSE 'wunderground' END AS source,
    CASE WHEN {key} % 3 = 0 THEN {code} ELSE 'ISTN' || {key} END AS source_id,
    {_ZONE},
    CASE WHEN r_regionkey <> 4 THEN r_name END AS country,
    TIMESTAMP '2023-01-01 00:00:00' + to_days(cast({key} * 37 % 300 AS integer)) AS created_at"""


STATIONS = f"""stations AS (
  SELECT cast(n_nationkey AS bigint) AS station_id, n_name AS name, {_common('n_nationkey')}
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

FLEET = f"""fleet AS (
  SELECT c_custkey AS station_id, c_name AS name, {_common('c_custkey')}
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

READINGS = """ev AS (
  SELECT *, floor(value) AS v, cast(json_extract_string(props, '$.k') AS integer) AS k, user_id % 25 AS station_id
  FROM events),
readings AS (
  SELECT event_id, user_id, event_type, value, k, station_id, ts AS observed_at, (v - 50) / 10 AS temp_c,
    k AS humidity, (v - 90) / 10 AS dewpoint_c,
    CASE WHEN v < 20 THEN (v - 65) / 10 END AS windchill_c, CASE WHEN v >= 80 THEN (v - 35) / 10 END AS heat_index_c,
    v / 4 AS wind_speed_kph, v / 2 AS wind_gust_kph,
    CASE WHEN event_type <> 'error' THEN cast(event_id * 37 % 360 AS integer) END AS wind_dir,
    cast(980 + k * 0.5 AS double) AS pressure_mb,
    CASE WHEN event_type = 'purchase' THEN v / 10 ELSE 0 END AS precip_rate_mm,
    CASE WHEN event_type = 'purchase' THEN v / 20 ELSE 0 END AS precip_total_mm,
    cast(k AS double) / 10 AS uv, CASE WHEN event_type <> 'signup' THEN v * 4 END AS solar_radiation,
    CASE WHEN v < 20 THEN (v - 65) / 10 WHEN v >= 80 THEN (v - 35) / 10 ELSE (v - 50) / 10 END AS feels_like_c,
    cast(station_id * 10 + 100 AS double) AS elevation,
    CASE WHEN station_id = 0 THEN cast(k AS double) / 20 + 18 END AS temp_indoor_c,
    CASE WHEN station_id = 0 THEN (k + 20) % 100 END AS humidity_indoor
  FROM ev)"""

LOCAL = """loc AS (
  SELECT r.*, s.timezone, timezone(coalesce(s.timezone, 'UTC'), timezone('UTC', r.observed_at)) AS local_ts,
    cast(timezone(coalesce(s.timezone, 'UTC'), timezone('UTC', r.observed_at)) AS date) AS local_day
  FROM readings r JOIN stations s ON s.station_id = r.station_id)"""

READING_COLUMNS = """station_id, observed_at, temp_c, humidity, dewpoint_c, windchill_c, heat_index_c, wind_speed_kph,
  wind_gust_kph, wind_dir, pressure_mb, precip_rate_mm, precip_total_mm, uv, solar_radiation, feels_like_c,
  elevation, temp_indoor_c, humidity_indoor"""


def dbl(x: str) -> str:
    return f"cast({x} AS double)"


def settle(x: str) -> str:
    return f"cast(cast({x} AS decimal(30,10)) AS double)"


def jr(x: str, n: int) -> str:
    return f"(floor({settle(x)} * {10**n} + 0.5) / {10**n})"


def pr(x: str, n: int) -> str:
    return f"cast(round(cast({x} AS decimal(30,10)), {n}) AS double)"


def bearing(east: str, north: str) -> str:
    def fixed(x: str) -> str:
        return f"cast(cast({x} AS decimal(20,12)) AS double)"

    angle = f"degrees(atan2({fixed(east)}, {fixed(north)})) + 360"
    return f"({pr(angle, 6)} % 360)"


def circ(deg: str) -> str:
    return bearing(f"avg(sin(radians({deg})))", f"avg(cos(radians({deg})))")


def circ_int(deg: str) -> str:
    return f"cast({jr(circ(deg), 0)} % 360 AS integer)"


def num(x: str) -> str:
    return f"regexp_replace(cast({x} AS varchar), '\\.0$', '')"


POINTS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


def compass(deg: str) -> str:
    return f"coalesce({POINTS}[cast(floor({deg} / 22.5 + 0.5) AS integer) % 16 + 1], '—')"


DAILY_METRICS = ["temp_avg", "temp_min", "temp_max", "temp_indoor_c", "feels_like_c", "dewpoint_c", "humidity",
                 "humidity_indoor", "pressure_mb", "wind_speed_kph", "wind_gust_kph", "wind_dir", "precip_total_mm",
                 "precip_rate_mm", "uv", "solar_radiation", "sunshine_hours"]
DAILY_LIST = ", ".join(["station_id", "day", *DAILY_METRICS])

_DAILY = {
    "temp_avg": "avg(p) / 10 - 20", "temp_min": "(min(p) - 200) / 10", "temp_max": "(max(p) - 200) / 10",
    "temp_indoor_c": "avg(CASE WHEN c_nationkey = 0 THEN p END) / 50 + 15", "feels_like_c": "avg(p) / 10 - 21",
    "dewpoint_c": "min(p) / 20 - 15", "humidity": "avg(p % 100)",
    "humidity_indoor": "avg(CASE WHEN c_nationkey = 0 THEN p % 60 END) + 20", "pressure_mb": "avg(p % 80) + 980",
    "wind_speed_kph": "avg(p % 40)", "wind_gust_kph": "max(p) / 5", "wind_dir": "min(o_orderkey * 37 % 360)",
    "precip_total_mm": "max(CASE WHEN o_orderstatus = 'F' THEN p END) / 50", "precip_rate_mm": "min(p) / 100",
    "uv": "avg(p % 12)", "solar_radiation": "avg(p) * 2",
    "sunshine_hours": "avg(CASE WHEN o_orderstatus = 'F' THEN p END) / 40",
}
DAILY = f"""priced AS (
  SELECT *, floor(o_totalprice / 1000) AS p FROM orders JOIN customer ON o_custkey = c_custkey),
daily AS (
  SELECT cast(c_nationkey AS bigint) AS station_id, cast(o_orderdate AS date) AS day,
    {', '.join(f'{pr(v, 1)} AS {n}' for n, v in _DAILY.items())}
  FROM priced GROUP BY c_nationkey, cast(o_orderdate AS date))"""

_MEANS = {"temp_avg": "temp_c", "temp_indoor_c": "temp_indoor_c", "feels_like_c": "feels_like_c",
          "dewpoint_c": "dewpoint_c", "humidity": "humidity", "humidity_indoor": "humidity_indoor",
          "pressure_mb": "pressure_mb", "wind_speed_kph": "wind_speed_kph", "uv": "uv"}
SUN_COUNT = f"""CASE WHEN count(solar_radiation) > 0 THEN
    {pr('count(*) FILTER (solar_radiation >= 120) * 10 / 60.0', 1)} END"""
ROLLUP_AGGS = ", ".join([
    *[f"{pr(f'avg({src})', 1)} AS {out}" for out, src in _MEANS.items()],
    f"{pr('min(temp_c)', 1)} AS temp_min", f"{pr('max(temp_c)', 1)} AS temp_max",
    f"{pr('max(wind_gust_kph)', 1)} AS wind_gust_kph", f"{circ('wind_dir')} AS wind_dir",
    f"{pr('max(precip_total_mm)', 2)} AS precip_total_mm", f"{pr('max(precip_rate_mm)', 2)} AS precip_rate_mm",
    f"{pr('avg(solar_radiation)', 0)} AS solar_radiation", f"{SUN_COUNT} AS sunshine_hours"])


def rollup(where: str = "true", name: str = "rollup", source: str = "loc") -> str:
    return f"""{name} AS (
  SELECT station_id, local_day AS day, {ROLLUP_AGGS} FROM {source} WHERE {where} GROUP BY station_id, local_day)"""


def latest(columns: str = "*", name: str = "latest") -> str:
    return f"""{name} AS (
  SELECT {columns} FROM readings WHERE observed_at <= {AS_OF}
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) = 1)"""


def credits(source: str, keys: str, name: str = "credits") -> str:
    """Solar rows with the microseconds each is credited, the next row sought within ``keys``."""
    return f"""{name}_next AS (
  SELECT *, epoch_us(observed_at) AS us,
    lead(epoch_us(observed_at)) OVER (PARTITION BY {keys} ORDER BY observed_at) AS next_us
  FROM {source} WHERE solar_radiation IS NOT NULL),
{name} AS (
  SELECT *, CASE WHEN solar_radiation >= 120 AND next_us IS NOT NULL
    THEN least(next_us - us, 1800000000) ELSE 0 END AS credit FROM {name}_next)"""


SUN_HOURS = f"CASE WHEN count(*) >= 2 THEN {jr('cast(sum(credit) AS double) / 3600000000', 1)} END"

TODAY = f"""today AS (
  SELECT r.* FROM readings r JOIN stations s ON s.station_id = r.station_id
  WHERE r.observed_at <= {AS_OF} AND r.observed_at >= timezone('UTC', timezone(coalesce(s.timezone, 'UTC'),
    cast(cast(timezone(coalesce(s.timezone, 'UTC'), timezone('UTC', {AS_OF})) AS date) AS timestamp))))"""

TODAY_STATS = f"""{credits('today', 'station_id', 'tc')},
today_sun AS (SELECT station_id, {SUN_HOURS} AS sunshine FROM tc GROUP BY station_id),
today_agg AS (
  SELECT station_id, {jr('max(temp_c)', 1)} AS temp_high, {jr('min(temp_c)', 1)} AS temp_low,
    {jr('avg(temp_c)', 1)} AS temp_mean, {jr('avg(wind_speed_kph)', 1)} AS wind_mean,
    {jr('max(wind_gust_kph)', 1)} AS gust FROM today GROUP BY station_id),
today_stats AS (
  SELECT s.station_id, temp_high, temp_low, temp_mean, wind_mean, gust, l.precip_total_mm AS rain, sunshine
  FROM stations s LEFT JOIN today_agg a ON a.station_id = s.station_id
  LEFT JOIN latest l ON l.station_id = s.station_id LEFT JOIN today_sun u ON u.station_id = s.station_id)"""


def joined(*parts: str) -> str:
    return f"nullif(concat_ws(' · ', {', '.join(parts)}), '')"


HEADLINE = joined(
    f"'High ' || {num('temp_high')} || '° / low ' || {num('temp_low')} || '°'",
    f"CASE WHEN rain > 0 THEN {num(jr('rain', 1))} || ' mm rain' WHEN rain IS NOT NULL THEN 'dry' END",
    f"CASE WHEN gust > 0 THEN 'gusts to ' || {num('gust')} || ' km/h' END")

CARDS = f"""hour_wind AS (
  SELECT station_id, {jr('avg(wind_speed_kph)', 1)} AS avg_wind_kph FROM readings
  WHERE observed_at >= {AS_OF} - INTERVAL 1 HOUR AND observed_at <= {AS_OF} GROUP BY station_id),
cards AS (
  SELECT s.*, l.observed_at, l.temp_c, l.temp_indoor_c, l.wind_speed_kph, l.precip_total_mm, avg_wind_kph,
    temp_high, temp_low, temp_mean, wind_mean, gust, rain, sunshine, {HEADLINE} AS summary
  FROM stations s LEFT JOIN latest l ON l.station_id = s.station_id
  LEFT JOIN hour_wind w ON w.station_id = s.station_id JOIN today_stats t ON t.station_id = s.station_id)"""

LIVE = [STATIONS, READINGS, latest(), TODAY, TODAY_STATS, CARDS]


def select(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}"

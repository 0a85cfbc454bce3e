"""Queries that run the stores, the request router and the live tables through whole cycles over the event file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldobs.operators import ingest
from fieldobs.plans.requests import Network
from fieldobs.schema import DAILY_COLUMNS, READING_COLUMNS, SOURCE_DEVICE, SOURCE_PWS
from fieldobs.session import work_dir
from fieldobs.sources.store import DailyStore, ReadingStore, delete_stations
from fieldobs.workload import sql as S
from fieldobs.workload.adapters import AS_OF, Tables
from fieldobs.workload.collection import DEVICE_ROWS, PWS_ROWS, device_payloads, pws_payloads
from fieldobs.workload.registry import query


def _stores(t: Tables) -> tuple[ReadingStore, DailyStore]:
    folder = work_dir(t.spark, "stores")
    return (ReadingStore(t.spark, f"{folder}/raw", T.LongType()), DailyStore(t.spark, f"{folder}/daily", T.LongType()))


def _batch(t: Tables, condition: str) -> DataFrame:
    return t.measured_events.where(condition).select(*READING_COLUMNS, "event_id")


@query("store_upsert_cycle", S.select([S.READINGS], f"""
SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 1.5 ELSE temp_c END AS temp_c)
FROM (SELECT event_id, {S.READING_COLUMNS} FROM readings)""".replace("SELECT * REPLACE", "SELECT * EXCLUDE (event_id) REPLACE")))
def store_upsert_cycle(t: Tables) -> DataFrame:
    """Three merges: all rows, then corrections of every fifth, then of every third, nulls included."""
    store, _ = _stores(t)
    store.merge(_batch(t, "true"), "event_id")
    store.merge(_batch(t, "event_id % 5 = 0").withColumn("temp_c", F.lit(1.5)), "event_id")
    store.merge(_batch(t, "event_id % 3 = 0").withColumn("temp_c", F.lit(None).cast("double")), "event_id")
    return store.read().select(*READING_COLUMNS)


_PRUNED_AT = dt.datetime(2024, 1, 30, 12)
_RETENTION = 15
_LATE = "event_id % 7 = 0"


@query("store_rollup_late", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup(
    "(observed_at < TIMESTAMP '2024-01-28 00:00:00' AND event_id % 7 <> 0) OR observed_at >= TIMESTAMP '2024-01-28 00:00:00'",
    "early"), S.rollup("observed_at >= TIMESTAMP '2024-01-15 00:00:00'", "late")], f"""
SELECT {S.DAILY_LIST} FROM early e WHERE NOT (SELECT timezone('UTC', timezone(coalesce(timezone, 'UTC'), cast(e.day AS timestamp)))
  >= TIMESTAMP '2024-01-15 00:00:00' FROM stations s WHERE s.station_id = e.station_id)
UNION ALL
SELECT {S.DAILY_LIST} FROM late l WHERE (SELECT timezone('UTC', timezone(coalesce(timezone, 'UTC'), cast(l.day AS timestamp)))
  >= TIMESTAMP '2024-01-15 00:00:00' FROM stations s WHERE s.station_id = l.station_id)
  OR NOT EXISTS (SELECT 1 FROM early e WHERE e.station_id = l.station_id AND e.day = l.day)"""))
def store_rollup_late(t: Tables) -> DataFrame:
    """Merge, roll up, prune; then every seventh row arrives late, also for pruned days; roll up again.

    Pruned days keep their rollup rows; the days still held take the late rows in.
    """
    raw, daily = _stores(t)
    raw.merge(_batch(t, f"not ({_LATE}) or observed_at >= timestamp_ntz'2024-01-28'"), "event_id")
    daily.merge(raw, t.stations)
    raw.prune(_PRUNED_AT, _RETENTION)
    raw.merge(_batch(t, f"{_LATE} and observed_at < timestamp_ntz'2024-01-28'"), "event_id")
    daily.merge(raw, t.stations)
    return daily.read().select(*DAILY_COLUMNS)


@query("rollup_incremental", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def rollup_incremental(t: Tables) -> DataFrame:
    """Four merges, each followed by a rollup of what it touched: the same rows as one full rollup."""
    raw, daily = _stores(t)
    for part in ("observed_at < timestamp_ntz'2024-01-12' and event_id % 2 = 0", "observed_at >= timestamp_ntz'2024-01-12'",
                 "event_id % 4 = 1", "event_id % 4 = 3"):
        raw.merge(_batch(t, part), "event_id")
        daily.merge(raw, t.stations)
    return daily.read().select(*DAILY_COLUMNS)


@query("store_delete", S.select([S.READINGS, "kept AS (SELECT * FROM readings WHERE station_id NOT IN (3, 5))"], """
SELECT station_id, cast(observed_at AS date) AS obs_date, count(*) AS rows FROM kept GROUP BY station_id, cast(observed_at AS date)"""))
def store_delete(t: Tables) -> DataFrame:
    """Stations 0 (primary, so it stays), 3 and 5 are asked to go from both stores."""
    raw, daily = _stores(t)
    raw.merge(_batch(t, "true"), "event_id")
    daily.merge(raw, t.stations)
    delete_stations(raw, daily, t.stations, t.stations.where("station_id in (0, 3, 5)").select("station_id"))
    held = daily.read().select("station_id").distinct()
    return raw.read().join(held, "station_id", "left_semi").groupBy("station_id", "obs_date").agg(F.count("*").alias("rows"))


def _landed(t: Tables) -> DataFrame:
    """Both payload feeds; every eleventh row states no source, every thirteenth bears a wild clock."""
    pws = pws_payloads(t).withColumn("source", F.lit(SOURCE_PWS))
    device = device_payloads(t).withColumn("source", F.lit(SOURCE_DEVICE)).withColumn(
        "payload", F.when(F.col("event_id") % 13 == 0, F.regexp_replace("payload", r'"epoch":(\d+)', r'"epoch":$1000')).otherwise(F.col("payload")))
    rows = pws.unionByName(device).withColumn("source", F.when(F.col("event_id") % 11 != 0, F.col("source")))
    return rows.select("station_id", "source", F.col("event_id").alias("ingest_seq"), "payload")


@query("ingest_accounting", S.select([S.READINGS, PWS_ROWS, DEVICE_ROWS], """
SELECT (SELECT count(*) FROM pws WHERE event_id % 11 <> 0)
    + (SELECT count(*) FROM device WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) AS accepted,
  2 * (SELECT count(*) FROM readings) - (SELECT count(*) FROM pws WHERE event_id % 11 <> 0)
    - (SELECT count(*) FROM device WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) AS rejected,
  2 * (SELECT count(*) FROM readings) AS landed"""))
def ingest_accounting(t: Tables) -> DataFrame:
    """Every landed row is accepted or rejected."""
    landed = _landed(t)
    intake = ingest.Intake(landed)
    kinds = intake.accepted("ingest_seq").select(F.lit("accepted").alias("kind")).union(
        intake.rejected().select(F.lit("rejected"))).union(landed.select(F.lit("landed")))
    counted = kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("accepted", "rejected", "landed")])
    return counted


_STATION = 7


def _network(t: Tables) -> Network:
    from fieldobs.operators.daily import daily_rollup

    return Network(t.stations, t.readings, daily_rollup(t.readings, t.stations))


_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


def _raw_request(name: str, since: str) -> None:
    @query(f"network_{name}", S.select([S.STATIONS, S.READINGS, S.LOCAL], f"""
SELECT station_id, observed_at, temp_c FROM loc
WHERE station_id = {_STATION} AND observed_at >= {since} AND observed_at <= {_AS_OF}"""))
    def run(t: Tables) -> DataFrame:
        return _network(t).station_readings(_STATION, AS_OF, name).data.select("station_id", "observed_at", "temp_c")


_raw_request("today", f"timezone('UTC', timezone(coalesce(timezone, 'UTC'), date_trunc('day', timezone(coalesce(timezone, 'UTC'), timezone('UTC', {_AS_OF})))))")
_raw_request("7d", f"{_AS_OF} - INTERVAL 7 DAY")


_SILENT = "station_id % 2 = 0 AND observed_at >= TIMESTAMP '2024-01-20 00:00:00'"


@query("network_overview_stale", S.select([S.STATIONS, S.READINGS, f"""newest AS (
  SELECT station_id, observed_at, temp_c FROM readings WHERE observed_at <= {_AS_OF} AND NOT ({_SILENT})
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) = 1)"""], """
SELECT s.station_id, n.observed_at, n.temp_c FROM stations s LEFT JOIN newest n ON n.station_id = s.station_id"""))
def network_overview_stale(t: Tables) -> DataFrame:
    """All stations; half are silent, and the rollup lags or lacks them."""
    from fieldobs.operators.daily import daily_rollup

    rows = t.readings.where(~F.expr(_SILENT))
    rollup = daily_rollup(rows, t.stations).where("day <= DATE '2024-01-10' AND station_id % 8 <> 0")
    dated = rows.withColumn("obs_date", F.to_date("observed_at"))
    return Network(t.stations, dated, rollup).overview(AS_OF).select("station_id", "observed_at", "temp_c")


@query("network_30d", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup(
    f"observed_at >= {_AS_OF} - INTERVAL 30 DAY AND observed_at <= {_AS_OF}")], f"SELECT {S.DAILY_LIST} FROM rollup WHERE station_id = {_STATION}"))
def network_30d(t: Tables) -> DataFrame:
    return _network(t).station_readings(_STATION, AS_OF, "30d").data.select(*DAILY_COLUMNS)


@query("network_1y", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup()], f"""
SELECT {S.DAILY_LIST} FROM rollup WHERE station_id = {_STATION} AND day >= DATE '2023-01-30'"""))
def network_1y(t: Tables) -> DataFrame:
    return _network(t).station_readings(_STATION, AS_OF, "1y").data.select(*DAILY_COLUMNS)


@query("chart_series_30d", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup(
    f"observed_at >= {_AS_OF} - INTERVAL 30 DAY AND observed_at <= {_AS_OF}")], f"""
SELECT station_id, day, temp_avg, pressure_mb FROM rollup WHERE station_id = {_STATION}"""))
def chart_series_30d(t: Tables) -> DataFrame:
    return _network(t).chart_series(_STATION, AS_OF, "30d", ("temp_c", "pressure_mb")).data


@query("chart_series_7d", S.select([S.STATIONS, S.READINGS, S.LOCAL], f"""
SELECT station_id, time_bucket(INTERVAL 6 HOUR, local_ts) AS bucket_start, {S.jr('avg(temp_c)', 1)} AS temp_c,
  {S.jr('avg(pressure_mb)', 1)} AS pressure_mb FROM loc
WHERE station_id = {_STATION} AND observed_at >= {_AS_OF} - INTERVAL 7 DAY AND observed_at <= {_AS_OF}
GROUP BY station_id, time_bucket(INTERVAL 6 HOUR, local_ts)"""))
def chart_series_7d(t: Tables) -> DataFrame:
    series = _network(t).chart_series(_STATION, AS_OF, "7d", ("temp_c", "pressure_mb")).data
    return series.select("station_id", "bucket_start", "temp_c", "pressure_mb")


@query("chart_series_today", S.select([S.STATIONS, S.READINGS, S.LOCAL], f"""
SELECT station_id, observed_at, temp_c, pressure_mb FROM loc WHERE station_id = {_STATION} AND observed_at <= {_AS_OF}
  AND observed_at >= timezone('UTC', timezone(coalesce(timezone, 'UTC'), date_trunc('day', timezone(coalesce(timezone, 'UTC'), timezone('UTC', {_AS_OF})))))"""))
def chart_series_today(t: Tables) -> DataFrame:
    return _network(t).chart_series(_STATION, AS_OF, "today", ("temp_c", "pressure_mb")).data


@query("network_compare", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup(
    f"observed_at >= {_AS_OF} - INTERVAL 30 DAY AND observed_at <= {_AS_OF}"),
    "wanted AS (SELECT unnest([3, 7, 24, 99]) AS station_id)"], """
SELECT cast(w.station_id AS bigint) AS station_id, coalesce(s.name, cast(w.station_id AS varchar)) AS name, day, temp_avg, sunshine_hours
FROM wanted w LEFT JOIN stations s ON s.station_id = w.station_id LEFT JOIN rollup r ON r.station_id = w.station_id"""))
def network_compare(t: Tables) -> DataFrame:
    """Through the request, with a station that does not exist."""
    asked = t.spark.createDataFrame([(3,), (7,), (24,), (99,)], "station_id long")
    rows = _network(t).compare_stations(asked, AS_OF, "30d")
    return rows.select("station_id", "name", "day", "temp_avg", "sunshine_hours")


_NEW = 99


def _with_new_station(t: Tables) -> DataFrame:
    """The stations and one more, which never reported."""
    added = t.stations.where("station_id = 7").withColumn("station_id", F.lit(_NEW).cast("long")).withColumn("name", F.lit("New"))
    return t.stations.unionByName(added)


@query("network_overview_stores", S.select([S.STATIONS, S.READINGS, f"""newest AS (
  SELECT station_id, observed_at, temp_c FROM readings WHERE observed_at <= {_AS_OF} AND NOT ({_SILENT})
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) = 1)""",
    f"known AS (SELECT station_id FROM stations UNION ALL SELECT {_NEW})"], """
SELECT cast(k.station_id AS bigint) AS station_id, n.observed_at, n.temp_c FROM known k LEFT JOIN newest n ON n.station_id = k.station_id"""))
def network_overview_stores(t: Tables) -> DataFrame:
    """The stores' own table of newest rows answers: two merges, one rollup between them, half of the stations silent,
    one that never reported."""
    raw, daily = _stores(t)
    raw.merge(_batch(t, f"NOT ({_SILENT}) AND observed_at <= {_AS_OF} AND event_id % 3 = 0"), "event_id")
    daily.merge(raw, t.stations)
    raw.merge(_batch(t, f"NOT ({_SILENT}) AND observed_at <= {_AS_OF} AND event_id % 3 <> 0"), "event_id")
    return Network.of_stores(_with_new_station(t), raw, daily).overview(AS_OF).select("station_id", "observed_at", "temp_c")


@query("store_latest", S.select([S.READINGS], f"""
SELECT {S.READING_COLUMNS} FROM readings WHERE observed_at >= TIMESTAMP '2024-01-15 00:00:00' AND station_id <> 5
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) = 1"""))
def store_latest(t: Tables) -> DataFrame:
    """The table of newest rows after merges out of order, a prune and a delete."""
    raw, daily = _stores(t)
    raw.merge(_batch(t, "observed_at >= timestamp_ntz'2024-01-20' and event_id % 2 = 0"), "event_id")
    raw.merge(_batch(t, "observed_at < timestamp_ntz'2024-01-20' or event_id % 2 = 1"), "event_id")
    raw.prune(_PRUNED_AT, _RETENTION)
    delete_stations(raw, daily, t.stations, t.stations.where("station_id = 5").select("station_id"))
    return raw.latest().select(*READING_COLUMNS)


_TAIL = "observed_at >= timestamp_ntz'2024-01-28' or event_id % 11 = 0"


@query("network_live_tail", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def network_live_tail(t: Tables) -> DataFrame:
    """The rollup ran two days ago; rows since then, and late ones of any day, come from the raw store."""
    raw, daily = _stores(t)
    raw.merge(_batch(t, f"not ({_TAIL})"), "event_id")
    daily.merge(raw, t.stations)
    raw.merge(_batch(t, _TAIL), "event_id")
    return Network.of_stores(t.stations, raw, daily).days(AS_OF).select(*DAILY_COLUMNS)


@query("network_1y_behind", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup()], f"""
SELECT {S.DAILY_LIST} FROM rollup WHERE station_id = {_STATION} AND day >= DATE '2023-01-30'"""))
def network_1y_behind(t: Tables) -> DataFrame:
    """Plain tables, the rollup two days behind and its last day half done."""
    from fieldobs.operators.daily import daily_rollup

    rollup = daily_rollup(t.readings.where("observed_at < timestamp_ntz'2024-01-28 12:00:00'"), t.stations)
    net = Network(t.stations, t.readings, rollup, live_tail=True)
    return net.station_readings(_STATION, AS_OF, "1y").data.select(*DAILY_COLUMNS)

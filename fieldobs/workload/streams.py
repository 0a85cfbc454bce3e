"""Queries that run the streaming operators over the event file until it is used up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.operators.daily import rollup_from_partials
from fieldobs.schema import READING_COLUMNS, SOURCE_DEVICE, SOURCE_PWS
from fieldobs.session import work_dir
from fieldobs.sources.store import ReadingStore
from fieldobs.streaming import accounts, alerts, live
from fieldobs.workload import sql as S
from fieldobs.workload.adapters import Tables
from fieldobs.workload.collection import DEVICE_ROWS, PWS_ROWS, device_payloads, pws_payloads
from fieldobs.workload.registry import query


def _readings(t: Tables) -> DataFrame:
    return t.event_stream.select(*READING_COLUMNS)


def _naive(df: DataFrame, column: str = "observed_at") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query("stream_dedup", S.select([S.READINGS], f"SELECT {S.READING_COLUMNS} FROM readings"))
def stream_dedup(t: Tables) -> DataFrame:
    """Every reading delivered twice."""
    folder = work_dir(t.spark, "stream-dedup")
    twice = _readings(t).union(_readings(t))
    live.append_to(live.redelivery_free(twice), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return _naive(t.spark.read.parquet(f"{folder}/rows"))


def _partials(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "stream-partials")
    live.live_partials(_readings(t), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return _naive(live.partials_so_far(t.spark, f"{folder}/rows"), "bucket_start")


@query("stream_tumbling_15m", S.select([S.READINGS], f"""
SELECT station_id, time_bucket(INTERVAL 15 MINUTE, observed_at) AS bucket_start, count(temp_c) AS temp_n,
  {S.pr('sum(temp_c)', 4)} AS temp_sum, min(temp_c) AS temp_min, max(temp_c) AS temp_max,
  max(wind_gust_kph) AS gust, count(wind_dir) AS wind_n,
  {S.pr('sum(sin(radians(wind_dir)))', 6)} AS wind_east, {S.pr('sum(cos(radians(wind_dir)))', 6)} AS wind_north,
  count(*) FILTER (solar_radiation >= 120) AS sunny_n
FROM readings GROUP BY station_id, time_bucket(INTERVAL 15 MINUTE, observed_at)"""))
def stream_tumbling_15m(t: Tables) -> DataFrame:
    from fieldobs.functions.rounding import pg_round

    c = F.col
    return _partials(t).select(
        "station_id", "bucket_start", c("temp_c__n").alias("temp_n"), pg_round(c("temp_c__sum"), 4).alias("temp_sum"),
        c("temp_c__min").alias("temp_min"), c("temp_c__max").alias("temp_max"), c("wind_gust_kph__max").alias("gust"),
        "wind_n", pg_round(c("wind_east"), 6).alias("wind_east"), pg_round(c("wind_north"), 6).alias("wind_north"),
        "sunny_n")


@query("stream_rollup", S.select([S.STATIONS, S.READINGS, S.LOCAL, S.rollup()], f"SELECT {S.DAILY_LIST} FROM rollup"))
def stream_rollup(t: Tables) -> DataFrame:
    """Local days composed from streamed partials."""
    return rollup_from_partials(_partials(t), t.stations)


@query("stream_latest", S.select([S.READINGS], f"""
SELECT {S.READING_COLUMNS} FROM readings
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC) = 1"""))
def stream_latest(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "stream-latest")
    live.latest_live(_readings(t), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return live.newest_latest(t.spark, f"{folder}/rows")


@query("stream_stale", S.select([S.STATIONS, S.READINGS, """newest AS (
  SELECT station_id, max(observed_at) AS newest FROM readings GROUP BY station_id),
flagged AS (SELECT s.*, CASE WHEN source = 'weathercloud' THEN 120 ELSE 30 END AS minutes, newest
  FROM stations s LEFT JOIN newest n ON n.station_id = s.station_id)"""], """
SELECT station_id, name, source, minutes AS limit_minutes,
  name || ' (' || wunderground_id || '): no data in last ' || minutes || ' minutes' AS issue
FROM flagged WHERE coalesce(newest < TIMESTAMP '2024-01-31 00:00:00' - to_minutes(minutes), true)"""))
def stream_stale(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "stream-stale")
    live.latest_live(_readings(t), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return live.stale_now(t.stations, f"{folder}/rows", dt.datetime(2024, 1, 31))


@query("stream_station_feed", S.select([S.READINGS], """
SELECT station_id, observed_at, temp_c FROM readings WHERE station_id IN (3, 7, 24)"""))
def stream_station_feed(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "stream-feed")
    feed = live.station_feed(_readings(t).select("station_id", "observed_at", "temp_c"), [3, 7, 24])
    live.append_to(feed, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")


@query("stream_ingest", S.select([S.READINGS, PWS_ROWS, DEVICE_ROWS], f"""
SELECT 'p' || station_id AS station_id, observed_at, temp_c, humidity, wind_dir, feels_like_c, elevation FROM pws
UNION ALL
SELECT 'd' || station_id, observed_at, temp_c, humidity, wind_dir, feels_like_c, elevation FROM device
QUALIFY row_number() OVER (PARTITION BY station_id, observed_at ORDER BY event_id DESC) = 1"""))
def stream_ingest(t: Tables) -> DataFrame:
    """Both payload feeds land as JSON files and stream into a partitioned store."""
    folder = work_dir(t.spark, "stream-ingest")

    def landing(payloads: DataFrame, prefix: str, source: str) -> DataFrame:
        return payloads.select(F.concat(F.lit(prefix), F.col("station_id").cast("string")).alias("station_id"),
                               F.lit(source).alias("source"), F.col("event_id").alias("ingest_seq"), "payload")

    (landing(pws_payloads(t), "p", SOURCE_PWS).unionByName(landing(device_payloads(t), "d", SOURCE_DEVICE))
     .write.json(f"{folder}/landing"))
    store = ReadingStore(t.spark, f"{folder}/store")
    live.ingest_to_store(live.landed_payloads(t.spark, f"{folder}/landing"), store, f"{folder}/checkpoint",
                         f"{folder}/quarantine").awaitTermination()
    return store.read().select("station_id", "observed_at", "temp_c", "humidity", "wind_dir", "feels_like_c",
                               "elevation")


@query("stream_alerts", S.select([S.STATIONS, S.READINGS, """limits AS (
  SELECT station_id, name, wunderground_id, created_at, CASE WHEN source = 'weathercloud' THEN 120 ELSE 30 END AS minutes FROM stations),
seen AS (SELECT station_id, created_at AS told, false AS reported FROM limits
  UNION SELECT station_id, observed_at, true FROM readings),
gaps AS (SELECT s.*, minutes, name, wunderground_id, lead(s.told) OVER (PARTITION BY s.station_id ORDER BY s.told) AS next
  FROM seen s JOIN limits l ON l.station_id = s.station_id),
clock AS (SELECT max(observed_at) - INTERVAL 2 HOUR AS now FROM readings)"""], """
SELECT station_id, 'silent' AS kind, told + to_minutes(minutes) AS "at", CASE WHEN reported THEN told END AS observed_at,
  name || ' (' || wunderground_id || '): no data in last ' || minutes || ' minutes' AS issue
FROM gaps WHERE coalesce(next, (SELECT now FROM clock)) > told + to_minutes(minutes)
UNION ALL
SELECT station_id, 'returned', next, CASE WHEN reported THEN told END, NULL FROM gaps WHERE next > told + to_minutes(minutes)"""))
def stream_alerts(t: Tables) -> DataFrame:
    """Every silence of every station, by event time; those at the end of the file fire without a reading."""
    folder = work_dir(t.spark, "stream-alerts")
    found = alerts.silence_alerts(_readings(t), t.stations, by_event_time=True)
    live.append_to(found, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")


_CUT = "2024-01-20 00:00:00"


@query("stream_accounting", S.select([S.READINGS, f"""first AS (SELECT * FROM readings WHERE observed_at >= TIMESTAMP '{_CUT}'),
clock AS (SELECT date_trunc('milliseconds', max(observed_at)) - INTERVAL 2 HOUR AS now FROM first),
counts AS (SELECT 2 * (SELECT count(*) FROM first) + (SELECT count(*) FROM readings) AS landed,
  (SELECT count(*) FROM readings, clock WHERE observed_at <= now) AS late,
  (SELECT count(*) FROM first) + (SELECT count(*) FROM first, clock WHERE observed_at > now) AS duplicates)"""], """
SELECT landed, cast(landed - late - duplicates AS bigint) AS kept, duplicates, late,
  cast(landed - late - duplicates AS bigint) AS written FROM counts"""))
def stream_accounting(t: Tables) -> DataFrame:
    """The newer readings, the same again, then all there are: what comes again is a duplicate or too late, and every row
    is accounted for. (Spark takes a row as late by the watermark of the micro-batch before.)"""
    folder = work_dir(t.spark, "stream-accounting")
    rows = t.readings
    newer = rows.where(F.col("observed_at") >= F.lit(_CUT).cast("timestamp_ntz"))
    for part in (newer, newer, rows):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = live.admitted(t.spark.readStream.schema(rows.schema), max_files=1).parquet(f"{folder}/in")
    listener = accounts.Accounts(t.spark, f"{folder}/accounts", {folder})
    t.spark.streams.addListener(listener)
    query = live.append_to(live.redelivery_free(source), f"{folder}/rows", f"{folder}/checkpoint", name=folder)
    query.awaitTermination()
    listener.settled(query)
    t.spark.streams.removeListener(listener)
    written = t.spark.read.parquet(f"{folder}/rows").agg(F.count("*").alias("written"))
    return accounts.totals(t.spark, f"{folder}/accounts").drop("query").join(written)


@query("stream_ingest_backlog", S.select([S.READINGS, PWS_ROWS], """
SELECT cast(station_id AS varchar) AS station_id, observed_at, temp_c, humidity, wind_dir, feels_like_c, elevation FROM pws"""))
def stream_ingest_backlog(t: Tables) -> DataFrame:
    """Three files that waited are worked off one a micro-batch, with the rows one batch would give."""
    folder = work_dir(t.spark, "stream-backlog")
    rows = pws_payloads(t).select(F.col("station_id").cast("string").alias("station_id"), F.lit(SOURCE_PWS).alias("source"),
                                  F.col("event_id").alias("ingest_seq"), "payload")
    for part in range(3):
        rows.where(F.col("ingest_seq") % 3 == part).coalesce(1).write.mode("append").json(f"{folder}/landing")
    store = ReadingStore(t.spark, f"{folder}/store")
    payloads = live.landed_payloads(t.spark, f"{folder}/landing", max_files=1)
    live.ingest_to_store(payloads, store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select("station_id", "observed_at", "temp_c", "humidity", "wind_dir", "feels_like_c", "elevation")

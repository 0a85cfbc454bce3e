"""Time the operators on a generated network in which one station holds a third of the rows.

usage: python benchmarks/scale.py FOLDER [--stations 200] [--days 365] [--cpus 8] [operator ...]

The table is written to FOLDER once, by date, and read back for every operator.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldobs.functions import clock
from fieldobs.operators import buckets, compare, daily, latest, maintenance, scan, summary, sunshine
from fieldobs.schema import READING_COLUMNS, reading_schema
from fieldobs.session import build_session

START = dt.datetime(2023, 1, 1)
ZONES = ["America/Toronto", "Asia/Kolkata", "Pacific/Auckland", "Europe/London"]


def generate(spark: SparkSession, path: str, stations: int, days: int) -> None:
    """Ten-minute readings of every station, and a busy station 0 with half as many again."""
    per_station = days * 144
    even = spark.range(stations * per_station).select(
        (F.col("id") % stations + 1).alias("station_id"), (F.floor(F.col("id") / stations) * 600).alias("s"))
    busy_rows = stations * per_station // 2
    busy = spark.range(busy_rows).select(
        F.lit(0).cast("bigint").alias("station_id"), (F.col("id") * (days * 86400 / busy_rows)).alias("s"))
    r = F.abs(F.xxhash64("station_id", "s")) % 1000
    at = F.lit(str(START)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))
    values = {"temp_c": (r - 300) / 10, "humidity": r % 100, "dewpoint_c": (r - 400) / 10, "wind_speed_kph": r / 20,
              "wind_gust_kph": r / 10, "wind_dir": r % 360, "pressure_mb": 980 + r / 20, "precip_total_mm": r / 100,
              "precip_rate_mm": r / 200, "uv": r / 100, "solar_radiation": r * 1.0, "feels_like_c": (r - 310) / 10}
    rows = even.unionByName(busy.withColumn("s", F.col("s"))).select(
        "station_id", at.alias("observed_at"), *[v.alias(n) for n, v in values.items()])
    kinds = {f.name: f.dataType for f in reading_schema().fields}
    rows = rows.select("station_id", "observed_at", *[
        (F.col(n) if n in values else F.lit(None)).cast(kinds[n]).alias(n) for n in READING_COLUMNS[2:]])
    (rows.withColumn("obs_date", F.col("observed_at").cast("date")).repartition(64, "obs_date")
     .write.partitionBy("obs_date").parquet(path))


def station_table(spark: SparkSession, stations: int) -> DataFrame:
    rows = spark.range(stations + 1).select(
        F.col("id").alias("station_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("name"),
        F.get(F.array(*map(F.lit, ZONES)), (F.col("id") % 5).cast("int")).alias("timezone"),
        (F.col("id") == 0).alias("is_primary"), F.lit("wunderground").alias("source"),
        F.lit(None).cast("string").alias("country"), F.col("id").cast("string").alias("wunderground_id"),
        F.lit(str(START)).cast("timestamp_ntz").alias("created_at"))
    return clock.declare_zones(rows, ZONES)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("folder")
    parser.add_argument("--stations", type=int, default=200)
    parser.add_argument("--days", type=int, default=365)
    parser.add_argument("--cpus", default="8")
    parser.add_argument("operators", nargs="*")
    args = parser.parse_args()
    spark = build_session("scale", f"local[{args.cpus}]", **{
        "spark.sql.shuffle.partitions": "64", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.local.dir": f"{args.folder}/scratch"})
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{args.folder}/readings"
    if not os.path.exists(f"{path}/_SUCCESS"):
        generate(spark, path, args.stations, args.days)
    schema = reading_schema(spark.range(1).schema["id"].dataType).add("obs_date", "date")
    r = spark.read.schema(schema).parquet(path)
    st = station_table(spark, args.stations)
    as_of = START + dt.timedelta(days=args.days - 1, hours=12)
    day = as_of.date()
    keys = ["station_id", "observed_at", "temp_c"]
    batch = scan.readings_since(r, as_of - dt.timedelta(days=1), as_of).select(*READING_COLUMNS)
    operators = {
        "count": lambda: r.groupBy("station_id").count(),
        "daily_rollup": lambda: daily.daily_rollup(r, st),
        "rollup_from_partials": lambda: daily.rollup_from_partials(daily.quarter_hour_partials(r), st),
        "bucket_6h": lambda: buckets.bucket_6h(r, st, ["temp_c", "humidity", "wind_dir"]),
        "wind_rose": lambda: buckets.wind_rose(r),
        "latest_per_station": lambda: latest.latest_per_station(r, as_of),
        "station_cards": lambda: latest.station_cards(st, r, as_of),
        "stale_stations": lambda: latest.stale_stations(st, r, as_of),
        "sunshine_elapsed": lambda: sunshine.sunshine_elapsed(r),
        "sunshine_by_day": lambda: sunshine.sunshine_by_day(r, st),
        "sunshine_series_6h": lambda: sunshine.sunshine_series_6h(r, st),
        "sunshine_series_raw": lambda: sunshine.sunshine_series_raw(r, st),
        "sunshine_cumulative": lambda: sunshine.sunshine_cumulative(r, st),
        "recent_n": lambda: scan.recent_n(r.select(*keys), 200),
        "rainfall_window": lambda: summary.rainfall_window(r, st),
        "pressure_trend": lambda: summary.pressure_trend(r),
        "summary_period_stats": lambda: summary.summary_period_stats(r, st),
        "compare_days_hourly": lambda: compare.compare_days_hourly(r, st, day, day - dt.timedelta(days=1)),
        "upsert": lambda: maintenance.upsert(r.select(*READING_COLUMNS), batch),
    }
    rows = r.count()
    for name in args.operators or operators:
        start = time.perf_counter()
        operators[name]().write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
        print(json.dumps({"operator": name, "rows": rows, "sec": round(seconds, 2),
                          "rows_per_sec": round(rows / seconds)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

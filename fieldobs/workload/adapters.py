"""The given tables seen as stations, readings and daily rows.

- ``stations``/``readings``: 25 nations as stations, every event as one reading.
- ``daily``: every order, per nation of its customer and order day, as a daily row.
- ``fleet``: every customer as a station, for work on the dimension itself.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldobs.functions import clock
from fieldobs.functions.rounding import pg_round
from fieldobs.operators.ingest import feels_like
from fieldobs.schema import DAILY_COLUMNS, READING_COLUMNS, SOURCE_DEVICE, SOURCE_PWS
from fieldobs.session import use_utc

# Declared, so that no query starts with a job that reads footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}
AS_OF = dt.datetime(2024, 1, 30, 12)
DAILY_AS_OF = dt.date(1999, 6, 15)
ZONES = {0: "America/Toronto", 1: "Asia/Kolkata", 2: "Pacific/Auckland", 3: "Europe/London"}


def _zone(region: Column) -> Column:
    zone = F.lit(None).cast("string")
    for key, name in ZONES.items():
        zone = F.when(region == key, name).otherwise(zone)
    return zone


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def stations(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        rows = self.nations.select(key.alias("station_id"), F.col("n_name").alias("name"), *self._common(key))
        return clock.declare_zones(rows, ZONES.values())

    @cached_property
    def fleet(self) -> DataFrame:
        key = F.col("c_custkey")
        return (self.table("customer").join(self.nations, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(key.alias("station_id"), F.col("c_name").alias("name"), *self._common(key)))

    def _common(self, key: Column) -> list[Column]:
        device = key % 3 == 0
        code = F.when(key % 5 != 4, (key + 900000).cast("string"))
        pws = F.concat(F.lit("ISTN"), key.cast("string"))
        return [
            F.when(device, F.concat(F.lit("WC-"), F.coalesce(code, F.lit("?")))).otherwise(pws).alias("wunderground_id"),
            F.when(key % 7 != 0, (key * 131 % 18000) / 100.0 - 90.0).alias("latitude"),
            F.when(key % 7 != 0, (key * 197 % 36000) / 100.0 - 180.0).alias("longitude"),
            (key == 0).alias("is_primary"),
            F.when(device, SOURCE_DEVICE).otherwise(SOURCE_PWS).alias("source"),
            F.when(device, code).otherwise(pws).alias("source_id"),
            _zone(F.col("r_regionkey")).alias("timezone"),
            F.when(F.col("r_regionkey") != 4, F.col("r_name")).alias("country"),
            (F.lit("2023-01-01").cast("timestamp_ntz")
             + F.make_dt_interval((key * 37 % 300).cast("int"))).alias("created_at"),
        ]

    @cached_property
    def measured_events(self) -> DataFrame:
        return self.measured(self.table("events"))

    @cached_property
    def event_stream(self) -> DataFrame:
        """The event file as a stream of measured events."""
        files = self.spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet")
        return self.measured(files.parquet(self.sf_dir))

    @staticmethod
    def measured(events: DataFrame) -> DataFrame:
        """Events with their measurements, and the event columns."""
        parsed = events.select(
            "event_id", "user_id", "event_type", "value", (F.col("user_id") % 25).alias("station_id"),
            F.col("ts").cast("timestamp_ntz").alias("observed_at"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor("value").cast("double").alias("v"))
        k, v, kind, station = F.col("k"), F.col("v"), F.col("event_type"), F.col("station_id")
        return parsed.select(
            "event_id", "user_id", "event_type", "value", "k", "station_id", "observed_at",
            ((v - 50) / 10).alias("temp_c"), k.alias("humidity"), ((v - 90) / 10).alias("dewpoint_c"),
            F.when(v < 20, (v - 65) / 10).alias("windchill_c"),
            F.when(v >= 80, (v - 35) / 10).alias("heat_index_c"),
            (v / 4).alias("wind_speed_kph"), (v / 2).alias("wind_gust_kph"),
            F.when(kind != "error", (F.col("event_id") * 37 % 360).cast("int")).alias("wind_dir"),
            (k * 0.5 + 980.0).alias("pressure_mb"),
            F.when(kind == "purchase", v / 10).otherwise(0.0).alias("precip_rate_mm"),
            F.when(kind == "purchase", v / 20).otherwise(0.0).alias("precip_total_mm"),
            (k / 10).alias("uv"), F.when(kind != "signup", v * 4).alias("solar_radiation"),
            (station * 10 + 100.0).alias("elevation"),
            F.when(station == 0, k / 20 + 18.0).alias("temp_indoor_c"),
            F.when(station == 0, (k + 20) % 100).alias("humidity_indoor"),
        ).withColumn("feels_like_c", feels_like(F.col("windchill_c"), F.col("heat_index_c"), F.col("temp_c")))

    @cached_property
    def readings(self) -> DataFrame:
        return self.measured_events.select(*READING_COLUMNS)

    @cached_property
    def daily(self) -> DataFrame:
        p = F.floor(F.col("o_totalprice") / 1000).cast("double")
        done = F.col("o_orderstatus") == "F"
        means = {
            "temp_avg": F.avg(p) / 10 - 20, "temp_min": (F.min(p) - 200) / 10, "temp_max": (F.max(p) - 200) / 10,
            "temp_indoor_c": F.avg(F.when(F.col("c_nationkey") == 0, p)) / 50 + 15,
            "feels_like_c": F.avg(p) / 10 - 21, "dewpoint_c": F.min(p) / 20 - 15, "humidity": F.avg(p % 100),
            "humidity_indoor": F.avg(F.when(F.col("c_nationkey") == 0, p % 60)) + 20,
            "pressure_mb": F.avg(p % 80) + 980, "wind_speed_kph": F.avg(p % 40), "wind_gust_kph": F.max(p) / 5,
            "wind_dir": F.min(F.col("o_orderkey") * 37 % 360).cast("double"),
            "precip_total_mm": F.max(F.when(done, p)) / 50, "precip_rate_mm": F.min(p) / 100,
            "uv": F.avg(p % 12), "solar_radiation": F.avg(p) * 2, "sunshine_hours": F.avg(F.when(done, p)) / 40,
        }
        return (self.table("orders")
                .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(F.col("c_nationkey").cast("bigint").alias("station_id"),
                         F.col("o_orderdate").cast("date").alias("day"))
                .agg(*[pg_round(v, 1).alias(n) for n, v in means.items()])
                .select(*DAILY_COLUMNS))

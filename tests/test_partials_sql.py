"""Chart points from partials and rollups as SQL functions, against the direct forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldobs.operators import buckets, daily
from fieldobs.plans import sqlfunctions
from fieldobs.schema import DAILY_COLUMNS
from tests.conftest import at

METRICS = ["temp_c", "precip_total_mm", "wind_gust_kph", "wind_dir", "uv"]
# Half-hour and quarter-hour zones, a day of 23 and one of 25 hours, no zone.
ZONES = {"kolkata": "Asia/Kolkata", "nepal": "Asia/Kathmandu", "toronto": "America/Toronto", "auckland": "Pacific/Auckland",
         "adelaide": "Australia/Adelaide", "none": None}
DAYS = ["2024-03-09 18:00", "2024-11-02 18:00", "2024-04-06 06:00", "2024-09-28 06:00"]


@pytest.fixture(scope="module")
def network(spark, make):
    rows = []
    for n, station in enumerate(ZONES):
        for d, day in enumerate(DAYS):
            for k in range(48 * 4):
                rows.append({"station_id": station, "observed_at": str(at(day) + dt.timedelta(minutes=15 * k + (n * 7 + k * 3) % 15)),
                             "temp_c": float((k * 7 + n) % 23) / 3, "precip_total_mm": float(k % 5) / 7, "uv": None if n == 2 else float(k % 9),
                             "wind_dir": None if k % 11 == 0 else (k * 37 + d) % 360, "wind_gust_kph": float(k % 13), "solar_radiation": float(k % 200)})
    return make.readings(*rows).repartition(4).persist(), make.stations(*[{"station_id": s, "timezone": z} for s, z in ZONES.items()])


def same(got, want):
    assert got.columns == want.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got) == rows(want) != []


def test_points_from_partials(network):
    readings, stations = network
    partials = daily.quarter_hour_partials(readings)
    same(buckets.bucket_6h_from_partials(partials, stations, METRICS), buckets.bucket_6h(readings, stations, METRICS))
    same(buckets.bucket_daily_from_partials(partials, stations, METRICS), buckets.bucket_daily(readings, stations, METRICS))
    same(buckets.hourly_wind_from_partials(partials, stations), buckets.hourly_wind_direction(readings, stations))
    same(daily.rollup_from_partials(partials, stations), daily.daily_rollup(readings, stations))


def test_sql_functions(spark, network):
    readings, stations = network
    sqlfunctions.register(spark, readings, stations, ("r_test", "s_test"))
    since = at("2024-04-06 09:40")
    want = daily.readings_daily(readings, stations, since)
    same(spark.sql(f"SELECT * FROM rollup_days(TIMESTAMP_NTZ'{since}')"), want)
    one = spark.sql(f"SELECT * FROM readings_daily('nepal', TIMESTAMP_NTZ'{since}')")
    same(one, want.where("station_id = 'nepal'").select(*DAILY_COLUMNS[1:]))
    joined = spark.sql(f"SELECT s.station_id, d.* FROM s_test s, LATERAL readings_daily(s.station_id, TIMESTAMP_NTZ'{since}') d")
    same(joined, want)
    assert spark.sql("SELECT * FROM readings_daily('nobody', TIMESTAMP_NTZ'1970-01-01')").count() == 0
    assert spark.sql("SELECT * FROM readings_daily(NULL, TIMESTAMP_NTZ'1970-01-01')").count() == 0


def test_sql_arguments_reach_the_scan(spark, network, tmp_path):
    readings, stations = network
    readings.write.parquet(str(tmp_path / "r"))
    sqlfunctions.register(spark, spark.read.parquet(str(tmp_path / "r")), stations, ("r_test", "s_test"))
    rows = spark.sql("SELECT day, temp_avg FROM readings_daily('nepal', TIMESTAMP_NTZ'2024-04-06 09:40:00')")
    plan = rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(station_id,nepal)" in pushed and "GreaterThanOrEqual(observed_at" in pushed
    assert "precip" not in plan

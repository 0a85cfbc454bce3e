"""Stored files are laid out so that a read of one station skips the others."""

import datetime as dt

import pytest
from pyarrow import parquet as pq
from pyspark.sql import functions as F

from fieldobs.schema import DAILY_COLUMNS, READING_COLUMNS
from fieldobs.sources.store import DailyStore, ReadingStore
from tests.conftest import at

STATIONS, ROWS = 200, 144


@pytest.fixture(scope="module")
def network(spark, tmp_path_factory):
    """One date of 200 stations that report every ten minutes, merged in two batches."""
    folder = tmp_path_factory.mktemp("layout")
    raw = ReadingStore(spark, str(folder / "raw"), row_group_bytes=64 << 10)
    ids = spark.range(STATIONS * ROWS).select(
        F.format_string("station-%03d", F.col("id") % STATIONS).alias("station_id"),
        (F.lit(at("2024-01-10 00:00")) + F.make_dt_interval(mins=(F.floor(F.col("id") / STATIONS) * 10).cast("int"))).alias("observed_at"),
        *[(F.rand(i) * 50).cast("int" if "humidity" in c or c == "wind_dir" else "double").alias(c) for i, c in enumerate(READING_COLUMNS[2:])],
        F.col("id").alias("seq"))
    raw.merge(ids.where("id % 3 = 0"), "seq")
    raw.merge(ids.where("id % 3 <> 0"), "seq")
    stations = ids.select("station_id").distinct().withColumn("timezone", F.lit(None).cast("string"))
    daily = DailyStore(spark, str(folder / "daily"))
    daily.merge(raw, stations)
    return raw, daily


def scanned(df) -> int:
    """Rows that came out of the file scan, after row groups and pages were skipped and before any filter."""
    df.collect()
    found = []

    def walk(node):
        if "Scan" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert len(found) == 1
    return found[0]


def test_one_station_skips_the_others(network):
    raw, _ = network
    assert raw.read().count() == STATIONS * ROWS
    one = raw.read([dt.date(2024, 1, 10)]).where("station_id = 'station-117'").select("observed_at", "temp_c")
    assert one.count() == ROWS
    assert ROWS <= scanned(one) <= STATIONS * ROWS / 10
    hour = one.where((F.col("observed_at") >= F.lit(at("2024-01-10 05:00"))) & (F.col("observed_at") < F.lit(at("2024-01-10 06:00"))))
    assert hour.count() == 6


def test_files_are_in_order(network):
    raw, daily = network
    for store, key in ((raw, ["station_id", "observed_at"]), (daily, ["station_id", "day"])):
        files = raw.spark.read.parquet(store.path).inputFiles()
        assert files
        for file in files:
            path = file.removeprefix("file://")
            table = pq.read_table(path, columns=key, partitioning=None).to_pylist()
            assert table == sorted(table, key=lambda r: [r[k] for k in key])
            metadata = pq.ParquetFile(path).metadata
            assert store is daily or metadata.num_row_groups > 10
            assert metadata.row_group(0).column(0).statistics.has_min_max


def test_an_absent_station_reads_nothing(network):
    """Between the smallest and the largest id of every row group, yet in none of them."""
    raw, _ = network
    assert scanned(raw.read().where("station_id = 'station-117x'").select("temp_c")) <= STATIONS * ROWS / 50


def test_the_layout_survives_a_delete(network, spark):
    raw, daily = network
    gone = spark.createDataFrame([("station-003",)], "station_id string")
    raw.remove_stations(gone)
    daily.remove_stations(gone)
    assert raw.read().count() == (STATIONS - 1) * ROWS and daily.read().select(*DAILY_COLUMNS).count() == STATIONS - 1
    assert scanned(raw.read().where("station_id = 'station-117'").select("temp_c")) <= STATIONS * ROWS / 10

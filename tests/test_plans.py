"""The physical plans the operators are meant to have."""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from fieldobs.operators import compare, daily, ingest, latest, maintenance, scan, summary, sunshine
from fieldobs.plans.requests import Network
from fieldobs.plans.timewin import Period
from fieldobs.schema import READING_COLUMNS
from fieldobs.sources.store import ReadingStore
from fieldobs.workload import load
from fieldobs.workload.adapters import AS_OF, Tables

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "readings")
    t = Tables(spark, SF)
    t.readings.withColumn("obs_date", F.col("observed_at").cast("date")).write.partitionBy("obs_date").parquet(path)
    return spark.read.parquet(path), t.stations


def test_window_reaches_the_scan(stored):
    readings, _ = stored
    text = plan(scan.readings_between(readings, "2024-01-10", "2024-01-12", [3]).select("station_id", "temp_c"))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThanOrEqual(observed_at" in pushed and "LessThan(observed_at" in pushed and "station_id" in pushed
    assert "PartitionFilters: [isnotnull(obs_date" in text
    columns = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert set(re.findall(r"(\w+):", columns)) == {"station_id", "observed_at", "temp_c"}


def test_today_is_bounded_at_the_scan(stored):
    readings, stations = stored
    text = plan(scan.today_so_far(readings, stations, AS_OF))
    assert "GreaterThanOrEqual(observed_at" in text and "BroadcastHashJoin" in text


def test_local_days_are_bounded_at_the_scan(stored):
    readings, stations = stored
    text = plan(scan.in_local_days(readings, stations, AS_OF.date(), AS_OF.date().replace(day=31)))
    assert "LessThan(observed_at" in text


def test_rollup_shuffles_once_and_combines_first(stored):
    readings, stations = stored
    text = plan(daily.daily_rollup(readings, stations), "simple")
    assert text.count("Exchange hashpartitioning") == 1 and text.count("HashAggregate") == 2
    assert "SortMergeJoin" not in text and "Python" not in text


def test_latest_does_not_sort(stored):
    readings, _ = stored
    text = plan(latest.latest_per_station(readings), "simple")
    assert "Sort" not in text and text.count("HashAggregate") == 2


def test_rankings_are_limited_before_the_shuffle(stored):
    readings, _ = stored
    text = plan(maintenance.last_write(readings.select(*READING_COLUMNS).withColumn("seq", F.lit(1)), "seq"), "simple")
    assert text.count("WindowGroupLimit") == 2
    text = plan(scan.recent_n(readings.select("station_id", "observed_at", "temp_c"), 200), "simple")
    assert text.count("WindowGroupLimit") == 4
    text = plan(scan.recent_n(readings.select("station_id", "observed_at", "temp_c"), 1200), "simple")
    assert text.count("WindowGroupLimit") == 4


def test_sunshine_windows_are_cut_by_time(stored):
    readings, stations = stored
    text = plan(sunshine.sunshine_elapsed(readings), "simple")
    assert re.search(r"hashpartitioning\(station_id#\d+L, hour#\d+L, lit#\d+", text)
    assert text.count("Exchange hashpartitioning") == 2
    text = plan(sunshine.sunshine_series_raw(readings, stations), "simple")
    assert re.search(r"hashpartitioning\(station_id#\d+L, chunk#\d+L", text)


def test_cumulative_sunshine_reads_twice(stored, spark):
    readings, stations = stored
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(sunshine.sunshine_cumulative(readings, stations), "simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    facts = [line for line in text.splitlines() if "FileScan" in line and "obs_date" in line]
    # Once for the readings, once for each station's last instant.
    assert len(facts) == 2 and text.count("Exchange hashpartitioning") <= 4


def test_window_figures_read_twice_and_shuffle_no_values(stored):
    readings, stations = stored
    text = plan(summary.summary_period_stats(readings, stations), "simple")
    facts = [line for line in text.splitlines() if "FileScan" in line and "obs_date" in line]
    assert len(facts) == 2 and "value#" not in "".join(l for l in text.splitlines() if "Exchange hashpartitioning" in l)


def test_periods_are_compared_in_one_scan(spark):
    rows = Tables(spark, SF).daily
    first = dt.date(1999, 6, 1)
    period = Period(first, dt.date(1999, 7, 1), "x")
    text = plan(compare.compare_periods_aligned(rows, period, period), "simple")
    assert text.count("FileScan") == plan(rows, "simple").count("FileScan") > 0


PRUNED = re.compile(r"PartitionFilters: \[[^\]]*(obs_date#\d+ IN|obs_date#\d+ INSET|obs_date#\d+ >=)")


def scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and "obs_date" in line]


def test_merge_reads_the_touched_days_only(stored, spark, tmp_path):
    readings, _ = stored
    store = ReadingStore(spark, str(tmp_path / "raw"), T.LongType())
    store.merge(readings.withColumn("seq", F.lit(1)).limit(50), "seq")
    days = store.partitions()
    assert scans(plan(store.read(days[:2]), "simple")) and all(PRUNED.search(s) for s in scans(plan(store.read(days[:2]), "simple")))


def test_requests_prune_partitions(stored, spark):
    """Every range of one station, and the cards with one station silent for weeks."""
    readings, stations = stored
    silent = readings.where("station_id <> 7 or observed_at < timestamp_ntz'2024-01-05'")
    rolled = daily.daily_rollup(silent, stations).persist()
    net = Network(stations, silent, rolled)
    for name in ("today", "7d", "30d"):
        answer = net.station_readings(3, AS_OF, name)
        for frame in (answer.data, answer.latest):
            found = scans(plan(frame, "simple"))
            assert found and all(PRUNED.search(s) for s in found), (name, found)
    found = scans(plan(net.overview(AS_OF), "simple"))
    assert found and all(PRUNED.search(s) for s in found)
    at = {r.station_id: r.observed_at for r in net.overview(AS_OF).collect()}
    newest = {r.station_id: r.observed_at for r in latest.latest_per_station(silent, AS_OF).collect()}
    assert {k: v for k, v in at.items() if v} == newest
    assert at[7] < dt.datetime(2024, 1, 5)


def test_compared_ids_reach_the_scan(stored, spark):
    readings, stations = stored
    asked = spark.createDataFrame([(3, 0), (5, 1)], "station_id long, position int")
    net = Network(stations, readings, daily.daily_rollup(readings, stations))
    text = plan(net.compare_stations(asked, AS_OF), "formatted")
    assert re.search(r"PushedFilters: .*In\(station_id, \[3,5\]\)", text)


@pytest.mark.parametrize("name", [n for n in load().QUERIES if not n.startswith(("stream_", "store_", "rollup_incremental", "ingest_accounting"))])
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, SF), "simple")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in text


def test_older_readings_are_not_scanned_without_silent_stations(stored):
    """Once every station is seen in the recent days, the older branch is dropped at run time."""
    readings, stations = stored
    reporting = stations.where("station_id < 15")
    rows = latest.latest_rows(reporting, readings, AS_OF, days=25)
    assert len(rows.collect()) == 15
    final = plan(rows, "simple").split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and final.count("FileScan") == 1 and "Union" not in final


def test_a_payload_is_parsed_once(spark):
    """One ``from_json`` in the plans of accepted and of rejected payloads."""
    rows = spark.createDataFrame([("s", "x", 1, "{}")], "station_id string, source string, ingest_seq long, payload string")
    for made in (ingest.ingest_pws(rows), ingest.ingest_device(rows), ingest.rejected_pws(rows), ingest.rejected_device(rows)):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert text.count("from_json") == 1, text

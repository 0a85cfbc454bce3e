"""Latest rows of silent stations do not depend on how current the rollup is."""

import pytest
from pyspark.sql import functions as F

from fieldobs.operators.latest import latest_per_station
from fieldobs.plans.requests import Network
from fieldobs.sources.store import DailyStore, ReadingStore, delete_stations
from tests.conftest import at

NOW = at("2024-01-30 12:00")


@pytest.mark.parametrize("rollup", [[], ["2024-01-03"], ["2024-01-03", "2024-01-30"], ["2024-01-30"]])
def test_stale_rollup(make, rollup):
    stations = make.stations({"station_id": "s"}, {"station_id": "t"}, {"station_id": "live"})
    rows = make.readings(*[{"station_id": i, "observed_at": t, "temp_c": v} for i, t, v in (
        ("s", "2024-01-03 10:00", 1.0), ("s", "2024-01-15 10:00", 2.0), ("s", "2024-01-30 13:00", 9.0),
        ("t", "2024-01-20 10:00", 3.0), ("live", "2024-01-30 11:00", 4.0))])
    daily = make.daily({"station_id": "t", "day": "2024-01-20"}, *[{"station_id": "s", "day": d} for d in rollup])
    net = Network(stations, rows.withColumn("obs_date", F.to_date("observed_at")), daily)
    assert {r.station_id: r.temp_c for r in net.overview(NOW).collect()} == {"s": 2.0, "t": 3.0, "live": 4.0}
    assert [r.temp_c for r in net.station_readings("s", NOW).latest.collect()] == [2.0]


def test_days_before_the_earliest_rollup_day_are_not_read(make):
    stations = make.stations({"station_id": "s"})
    rows = make.readings({"observed_at": "2024-01-15 10:00"}).withColumn("obs_date", F.to_date("observed_at"))
    net = Network(stations, rows, make.daily({"day": "2024-01-15"}))
    plan = net.station_readings("s", NOW).latest._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-01-14" in plan or "19736" in plan


@pytest.mark.parametrize("created", ["2024-01-18", None])
def test_a_station_the_rollup_does_not_know_is_sought_since_it_was_added(make, spark, created):
    stations = make.stations({"station_id": "s"}, {"station_id": "new"}, {"station_id": "none"}).withColumn(
        "created_at", F.lit(created).cast("timestamp_ntz"))
    rows = make.readings({"observed_at": "2024-01-20 10:00", "temp_c": 1.0}, {"station_id": "new", "observed_at": "2024-01-19 09:00", "temp_c": 2.0})
    net = Network(stations, rows.withColumn("obs_date", F.to_date("observed_at")), make.daily({"day": "2024-01-20"}))
    assert {r.station_id: r.temp_c for r in net.overview(NOW).collect()} == {"s": 1.0, "new": 2.0, "none": None}


def stores(spark, make, tmp_path):
    raw, rollup = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))

    def merge(seq, *rows):
        raw.merge(make.readings(*[{"station_id": i, "observed_at": t, "temp_c": v} for i, t, v in rows])
                  .withColumn("seq", F.lit(seq)), "seq")

    return raw, rollup, merge


def held(raw):
    kept = {r.station_id: (str(r.observed_at), r.temp_c) for r in raw.latest().collect()}
    again = {r.station_id: (str(r.observed_at), r.temp_c) for r in latest_per_station(raw.read()).collect()}
    assert kept == again
    return {i: v for i, (_, v) in kept.items()}


def test_newest_rows_follow_every_merge(make, spark, tmp_path):
    """Late and corrected rows, replays, retention and deletes; always as all history has it."""
    stations = make.stations({"station_id": "s"}, {"station_id": "t"}, {"station_id": "old"})
    raw, rollup, merge = stores(spark, make, tmp_path)
    assert raw.latest().count() == 0
    merge(1, ("s", "2024-01-10 10:00", 1.0), ("t", "2024-01-09 10:00", 2.0), ("old", "2024-01-01 10:00", 3.0))
    assert held(raw) == {"s": 1.0, "t": 2.0, "old": 3.0}
    merge(2, ("s", "2024-01-08 10:00", 9.0), ("t", "2024-01-09 10:00", 4.0))
    merge(2, ("s", "2024-01-08 10:00", 9.0), ("t", "2024-01-09 10:00", 4.0))
    assert held(raw) == {"s": 1.0, "t": 4.0, "old": 3.0}
    rollup.merge(raw, stations)
    raw.prune(at("2024-01-12 12:00"), 5)
    assert held(raw) == {"s": 1.0, "t": 4.0}
    merge(3, ("old", "2024-01-01 11:00", 5.0))  # too late: kept apart
    assert held(raw) == {"s": 1.0, "t": 4.0}
    delete_stations(raw, rollup, stations, stations.where("station_id in ('t', 'old')").select("station_id"))
    assert held(raw) == {"s": 1.0} and raw.late().count() == 0
    assert raw.touched() is None or {r.station_id for r in raw.touched().collect()} <= {"s"}
    raw._delete(raw._latest.path)  # a store from before there was such a table
    assert held(raw) == {"s": 1.0}


def test_values_are_completed_in_the_newest_row_too(make, spark, tmp_path):
    raw, _, _ = stores(spark, make, tmp_path)
    for seq, values in enumerate(({"temp_c": 1.0}, {"uv": 2.0})):
        raw.merge(make.readings({"observed_at": "2024-01-10 10:00", **values}).withColumn("seq", F.lit(seq)), "seq", coalesce_existing=True)
    row = raw.latest().collect()[0]
    assert (row.temp_c, row.uv) == (1.0, 2.0) == tuple(raw.read().select("temp_c", "uv").first())


def test_a_replay_after_a_prune_repeats_no_late_row(make, spark, tmp_path):
    raw, _, merge = stores(spark, make, tmp_path)
    merge(1, ("s", "2024-01-01 10:00", 1.0), ("s", "2024-01-20 10:00", 2.0))
    raw.prune(at("2024-01-21 12:00"), 5)
    for _ in range(2):
        merge(2, ("s", "2024-01-02 10:00", 3.0), ("s", "2024-01-20 11:00", 4.0))
    assert raw.late().count() == 1 and raw.read().count() == 2


def test_no_request_scans_history_with_the_table_of_newest_rows(make, spark, tmp_path):
    """Also with a station that never reported, and one that has been silent for long."""
    stations = make.stations({"station_id": "s"}, {"station_id": "silent"}, {"station_id": "never"})
    raw, rollup, merge = stores(spark, make, tmp_path)
    merge(1, ("s", "2024-01-30 11:00", 1.0), ("silent", "2024-01-02 10:00", 2.0), *[("s", f"2024-01-{d:02d} 10:00", 0.0) for d in range(3, 29)])
    rollup.merge(raw, stations)
    merge(2, ("s", "2024-01-30 11:30", 5.0))
    net = Network.of_stores(stations, raw, rollup)
    assert {r.station_id: r.temp_c for r in net.overview(NOW).collect()} == {"s": 5.0, "silent": 2.0, "never": None}
    for frame in (net.overview(NOW), *[net.station_readings(i, NOW).latest for i in ("s", "silent", "never")]):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan
        files = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
        history = [line for line in files if "obs_date" in line]
        assert all("obs_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in history)
    assert not [line for line in files if "obs_date" in line]  # the newest row alone reads no readings
    assert [r.temp_c for r in net.station_readings("silent", NOW).latest.collect()] == [2.0]
    # Asked for the past, the rows behind the newest one are searched.
    assert {r.station_id: r.temp_c for r in net.overview(at("2024-01-20 12:00")).collect()} == {"s": 0.0, "silent": 2.0, "never": None}

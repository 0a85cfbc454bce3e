"""Alerts by timers, accounts of streamed rows, limits on what a micro-batch takes."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldobs.session import work_dir
from fieldobs.sources.store import ReadingStore
from fieldobs.sources.tables import LANDING
from fieldobs.streaming import accounts, alerts, live
from tests.conftest import at


def source(spark, folder, rows, **limit):
    return live.admitted(spark.readStream.schema(rows.schema), **limit).parquet(f"{folder}/in")


def told(spark, folder):
    if not list(spark.read.schema(ALERTS).parquet(f"{folder}/out").inputFiles()):
        return []
    return sorted((r.station_id, str(r.at), r.kind, r.observed_at and str(r.observed_at)) for r in spark.read.parquet(f"{folder}/out").collect())


ALERTS = "station_id string, kind string, at timestamp_ntz, observed_at timestamp_ntz, issue string"


def test_silences_by_event_time_over_a_restart(spark, make):
    stations = make.stations({"station_id": "a", "created_at": "2024-01-01 00:00"}, {"station_id": "d", "source": "weathercloud", "created_at": "2024-01-01 00:00"},
                             {"station_id": "never", "created_at": "2024-01-01 01:00"})
    folder = work_dir(spark, "test-alerts")

    def run(*rows):
        frame = make.readings(*[{"station_id": i, "observed_at": f"2024-01-01 {t}"} for i, t in rows])
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = alerts.silence_alerts(source(spark, folder, frame), stations, by_event_time=True, delay="10 minutes")
        live.append_to(found, f"{folder}/out", f"{folder}/cp").awaitTermination()
        return told(spark, folder)

    day = "2024-01-01 "
    first = run(("a", "00:10"), ("a", "00:40"), ("d", "00:10"), ("x", "00:05"))
    assert first == []  # 30 minutes are the limit itself; the clock stands at 00:30
    second = run(("a", "01:30"), ("d", "01:50"), ("a", "00:45"))
    assert second == [("a", day + "01:15:00", "silent", day + "00:45:00"), ("a", day + "01:30:00", "returned", day + "00:45:00"),
                      ("never", day + "01:30:00", "silent", None)]
    third = run(("d", "03:00"))  # nothing of a: its timer runs out
    assert third[3:] == [("never", day + "01:30:00", "silent", None)] and third[2] == ("a", day + "02:00:00", "silent", day + "01:30:00")
    assert run(("d", "03:10"))[3:] == third[3:]  # told once
    last = run(("a", "03:20"), ("a", "03:30"))
    assert ("a", day + "03:20:00", "returned", day + "01:30:00") in last and len(last) == 5
    now = {r.station_id: r.issue for r in alerts.current_alerts(spark.read.parquet(f"{folder}/out")).collect()}
    assert now == {"never": "NEVER (never): no data in last 30 minutes"}


def test_alerts_in_a_session_with_the_default_state_store(spark):
    """Timers need RocksDB, which a session that others built may not have."""
    plain, sf = spark.newSession(), "/root/testdata/sf0.001"
    plain.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    got, want = (sorted(map(str, entry.queries()["stream_alerts"](s, sf).collect())) for s in (plain, spark))
    assert got == want != []


def test_an_alert_fires_without_any_input(spark, make):
    """By the clock of the triggers: a station that stops is told of once, and once when it is back."""
    folder = work_dir(spark, "test-clock")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stations = make.stations({"station_id": "a", "created_at": str(now - dt.timedelta(hours=5))})

    def land(instant):
        rows = make.readings({"station_id": "a", "observed_at": str(instant)})
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return rows

    seen = now - dt.timedelta(minutes=30) + dt.timedelta(seconds=12)
    rows = land(seen)
    query = live.append_to(alerts.silence_alerts(source(spark, folder, rows), stations), f"{folder}/out", f"{folder}/cp", every="1 second")
    try:
        def wait(kinds, seconds=60):
            until = time.monotonic() + seconds
            while time.monotonic() < until:
                found = [k for _, _, k, _ in told(spark, folder)] if query.lastProgress else []
                if found == kinds:
                    return True
                time.sleep(0.5)
            return found

        before = ["silent", "returned"]  # from when it was added until its first reading
        assert wait(before) is True
        assert wait([*before, "silent"]) is True  # no file has come since
        time.sleep(3)
        assert [k for _, _, k, _ in told(spark, folder)] == [*before, "silent"]
        land(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        assert wait([*before, "silent", "returned"]) is True
    finally:
        query.stop()


def test_every_row_is_kept_a_duplicate_or_late(spark, make):
    folder = work_dir(spark, "test-accounts")
    parts = [["10:00", "10:05"], ["10:05", "12:30"], ["10:00", "12:31"], ["09:00", "12:31", "10:29", "12:40"]]
    for part in parts:
        rows = make.readings(*[{"observed_at": f"2024-01-01 {t}"} for t in part])
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    listener = accounts.Accounts(spark, f"{folder}/accounts", {"feed"})
    spark.streams.addListener(listener)
    try:
        kept = live.redelivery_free(source(spark, folder, rows, max_files=1))
        query = live.append_to(kept, f"{folder}/out", f"{folder}/cp", name="feed")
        other = live.append_to(live.station_feed(source(spark, folder, rows)), f"{folder}/other", f"{folder}/cp2")
        for q in (query, other):
            q.awaitTermination()
            assert listener.settled(q)
    finally:
        spark.streams.removeListener(listener)
    total = accounts.totals(spark, f"{folder}/accounts").collect()
    assert [r["query"] for r in total] == ["feed"]
    written = spark.read.parquet(f"{folder}/out").count()
    assert (total[0].landed, total[0].kept) == (10, written)
    assert total[0].landed == total[0].kept + total[0].duplicates + total[0].late and total[0].late >= 2 and total[0].duplicates >= 2
    assert accounts.accounts(spark, f"{folder}/accounts").count() == 4


@pytest.mark.parametrize("limit, batches", [({"max_files": 2}, 3), ({"max_bytes": 1}, 5), ({}, 1)])
def test_a_backlog_is_worked_off_in_parts(spark, tmp_path, limit, batches):
    folder, store = str(tmp_path / "landing"), ReadingStore(spark, str(tmp_path / "store"))
    for n in range(5):
        payload = json.dumps({"epoch": 1704067200 + n // 2 * 600, "temp": float(n)})
        spark.createDataFrame([("d", "weathercloud", n, payload)], LANDING).coalesce(1).write.mode("append").json(folder)
    query = live.ingest_to_store(live.landed_payloads(spark, folder, **limit), store, str(tmp_path / "cp"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == batches
    got = {r.observed_at: r.temp_c for r in store.read().collect()}
    assert got == {at("2024-01-01 00:00"): 1.0, at("2024-01-01 00:10"): 3.0, at("2024-01-01 00:20"): 4.0}
    assert [r.temp_c for r in store.latest().collect()] == [4.0]


def test_one_limit_at_a_time(spark):
    with pytest.raises(ValueError):
        live.admitted(spark.readStream, max_files=1, max_bytes=1)

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldobs.operators import maintenance
from fieldobs.operators.daily import daily_rollup
from fieldobs.sources import tables
from fieldobs.sources.store import DailyStore, ReadingStore, backfill_rollup, delete_stations, roll_up_and_prune
from tests.conftest import at, one


def sequenced(make, *rows):
    frames = [make.readings(row).withColumn("seq", F.lit(i)) for i, row in enumerate(rows)]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def test_last_write_wins_entirely(make):
    batch = sequenced(make, {"observed_at": "2024-01-01 00:00", "temp_c": 1.0, "uv": 2.0},
                      {"observed_at": "2024-01-01 00:00", "temp_c": None, "uv": 3.0})
    row = one(maintenance.last_write(batch, "seq"))
    assert (row.temp_c, row.uv) == (None, 3.0)


def test_upsert_is_idempotent(make):
    stored = make.readings({"observed_at": "2024-01-01 00:00", "temp_c": 1.0, "uv": 1.0}, {"observed_at": "2024-01-01 00:10", "temp_c": 2.0})
    batch = make.readings({"observed_at": "2024-01-01 00:00", "uv": 5.0}, {"observed_at": "2024-01-01 00:20", "temp_c": 3.0})
    once = maintenance.upsert(stored, batch)
    got = once.orderBy("observed_at").collect()
    assert [(r.temp_c, r.uv) for r in got] == [(None, 5.0), (2.0, None), (3.0, None)]
    assert maintenance.upsert(once, batch).orderBy("observed_at").collect() == got
    kept = maintenance.upsert(stored, batch, coalesce_existing=True).orderBy("observed_at").collect()
    assert [(r.temp_c, r.uv) for r in kept] == [(1.0, 5.0), (2.0, None), (3.0, None)]


def test_delete_spares_the_primary(spark, make):
    stations = make.stations({"station_id": "p", "is_primary": True}, {"station_id": "x"}, {"station_id": "y"})
    asked = spark.createDataFrame([("p",), ("x",), ("x",)], "station_id string")
    removed = maintenance.removable(stations, asked)
    rows = make.readings(*[{"station_id": s, "observed_at": "2024-01-01 00:00"} for s in "pxy"])
    assert {r.station_id for r in maintenance.without_stations(stations, removed).collect()} == {"p", "y"}
    assert {r.station_id for r in maintenance.without_stations(rows, removed).collect()} == {"p", "y"}


def test_store_merges_and_prunes_whole_days(spark, make, tmp_path):
    """A second rollup after pruning leaves the boundary day as it was."""
    stations = make.stations({"station_id": "s", "timezone": "Pacific/Auckland"})
    readings = ReadingStore(spark, str(tmp_path / "raw"))
    daily = DailyStore(spark, str(tmp_path / "daily"))
    assert readings.read().count() == 0 and readings.horizon() is None
    start = at("2024-01-01 00:00")
    rows = [{"observed_at": str(start + dt.timedelta(hours=h)), "temp_c": float(h % 24)} for h in range(24 * 6)]
    readings.merge(make.readings(*rows).withColumn("seq", F.lit(1)), "seq")
    assert len(readings.partitions()) == 6
    now = at("2024-01-06 12:00")
    assert roll_up_and_prune(readings, daily, stations, now, 3) == 48
    assert readings.horizon() == at("2024-01-03 00:00")
    before = daily.read().orderBy("day").collect()
    assert len(before) == 7 and str(before[0].day) == "2024-01-01"
    assert roll_up_and_prune(readings, daily, stations, now, 3) == 0
    assert daily.read().orderBy("day").collect() == before
    # A late row inside the kept days changes its own day only.
    readings.merge(make.readings({"observed_at": "2024-01-04 13:30", "temp_c": 90.0}).withColumn("seq", F.lit(2)), "seq")
    daily.merge(readings, stations)
    after = daily.read().orderBy("day").collect()
    assert [str(a.day) for a, b in zip(after, before) if a != b] == ["2024-01-05"]
    assert readings.read().count() == 24 * 4 + 1


def test_store_replaces_a_redelivered_key(spark, make, tmp_path):
    store = ReadingStore(spark, str(tmp_path / "raw"))
    row = {"observed_at": "2024-01-01 00:00", "temp_c": 1.0}
    for seq, temp in ((1, 1.0), (2, 7.0), (2, 7.0)):
        store.merge(make.readings({**row, "temp_c": temp}).withColumn("seq", F.lit(seq)), "seq")
    assert one(store.read()).temp_c == 7.0


def test_backfill_after_a_new_column(spark, make, tmp_path):
    """Files written before a column existed read as null until the rollup is recomputed."""
    stations = make.stations()
    rows = make.readings({"observed_at": "2024-01-01 10:00", "solar_radiation": 500.0}, {"observed_at": "2024-01-01 10:10", "solar_radiation": 500.0})
    readings, daily = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))
    readings.merge(rows.withColumn("seq", F.lit(1)), "seq")
    old = daily_rollup(rows, stations).drop("sunshine_hours").withColumn("day_month", F.trunc("day", "month"))
    old.write.partitionBy("day_month").parquet(daily.path)
    assert one(daily.read()).sunshine_hours is None
    backfill_rollup(readings, daily, stations)
    assert one(daily.read()).sunshine_hours == 0.3
    assert tables.daily(spark, daily.path).count() == 1 and tables.readings(spark, readings.path).count() == 2


def test_horizon_day_is_taken_from_raw_only_when_missing(make):
    stations = make.stations()
    raw = make.readings({"observed_at": "2024-01-02 20:00", "temp_c": 9.0}, {"observed_at": "2024-01-03 01:00", "temp_c": 4.0})
    stored = make.daily({"day": "2024-01-02", "temp_avg": 1.0}, {"day": "2024-01-01", "temp_avg": 0.5})
    got = maintenance.rollup_refresh(stored, raw, stations, at("2024-01-02 12:00")).orderBy("day").collect()
    assert [r.temp_avg for r in got] == [0.5, 1.0, 4.0]
    got = maintenance.rollup_refresh(stored.where("false"), raw, stations, at("2024-01-02 12:00")).orderBy("day").collect()
    assert [r.temp_avg for r in got] == [9.0, 4.0]


def test_prune_report(make):
    rows = make.series("temp_c", [("2024-01-01 11:00", 1.0), ("2024-01-01 13:00", 1.0), ("2024-01-02 00:00", 1.0)])
    got = one(maintenance.prune_report(rows, at("2024-01-04 12:00"), 3))
    assert (got.kept, got.pruned) == (3, 0)
    got = one(maintenance.prune_report(rows, at("2024-01-05 12:00"), 3))
    assert (got.kept, got.pruned) == (1, 2)
    assert maintenance.retained(rows, at("2024-01-05 12:00"), 3).count() == 1


def held_rows(store):
    return {(r.station_id, str(r.observed_at)): r.temp_c for r in store.read().collect()}


def hourly(make, start, hours, value=None):
    begin = at(start)
    return make.readings(*[{"observed_at": str(begin + dt.timedelta(hours=h)), "temp_c": float(h % 24) if value is None else value}
                           for h in range(hours)]).withColumn("seq", F.lit(1))


def test_rows_of_pruned_days_are_kept_apart(spark, make, tmp_path):
    """A late row after a prune changes no rollup day, and is not lost."""
    stations = make.stations({"station_id": "s", "timezone": "Pacific/Auckland"})
    readings, daily = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))
    readings.merge(hourly(make, "2024-01-01 00:00", 24 * 6), "seq")
    roll_up_and_prune(readings, daily, stations, at("2024-01-06 12:00"), 3)
    before = daily.read().orderBy("day").collect()
    assert readings.late() is None and str(readings.pruned_before()) == "2024-01-03"
    readings.merge(hourly(make, "2024-01-01 13:00", 1, 99.0), "seq")
    assert [str(d) for d in readings.partitions()][0] == "2024-01-03" and readings.late().count() == 1
    daily.merge(readings, stations)
    backfill_rollup(readings, daily, stations)
    assert daily.read().orderBy("day").collect() == before


@pytest.mark.parametrize("moment", ["staged", "applying", "staging"])
def test_interrupted_merge_loses_nothing(spark, make, tmp_path, moment, monkeypatch):
    """Killed before, during and after the overwrite; the next job ends with all rows."""
    store = ReadingStore(spark, str(tmp_path / "raw"))
    store.merge(hourly(make, "2024-01-01 00:00", 30), "seq")

    def stop(self):
        if moment == "applying":  # what an overwrite does first
            self._delete(f"{self.path}/obs_date=2024-01-01")
        raise RuntimeError("killed")

    batch = hourly(make, "2024-01-01 10:30", 20, 50.0)
    monkeypatch.setattr(ReadingStore, "_apply", stop)
    if moment == "staging":
        monkeypatch.setattr(ReadingStore, "_at", lambda self, path, real=ReadingStore._at: stop(self) if path.endswith("_COMPLETE") and store._exists(store.path + "__staging") else real(self, path))
    with pytest.raises(RuntimeError):
        store.merge(batch, "seq")
    monkeypatch.undo()
    assert store._exists(store.path + "__staging")
    if moment == "staging":
        store.recover()
        assert len(held_rows(store)) == 30
    store.merge(batch, "seq")
    rows = held_rows(store)
    assert len(rows) == 50 and sum(v == 50.0 for v in rows.values()) == 20
    assert not store._exists(store.path + "__staging")


def test_incremental_rollup_equals_a_full_one(spark, make, tmp_path):
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"})
    readings, daily = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))
    whole = DailyStore(spark, str(tmp_path / "whole"))
    for start, hours, value in (("2024-01-30 00:00", 60, None), ("2024-01-31 05:30", 3, 70.0), ("2024-03-01 00:00", 5, 1.0)):
        readings.merge(hourly(make, start, hours, value), "seq")
        daily.merge(readings, stations)
        assert readings.touched() is None
    whole.rebuild(readings, stations)
    assert daily.read().orderBy("day").collect() == whole.read().orderBy("day").collect()
    daily.merge(readings, stations)  # nothing is touched
    assert daily.read().count() == whole.read().count()


def test_odd_folders_and_deletes(spark, make, tmp_path):
    stations = make.stations({"station_id": "p", "is_primary": True}, {"station_id": "x"})
    readings, daily = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))
    rows = make.readings(*[{"station_id": s, "observed_at": f"2024-01-0{d} 00:00", "temp_c": 1.0} for s, d in (("p", 1), ("x", 1), ("x", 2))])
    readings.merge(rows.withColumn("seq", F.lit(1)), "seq")
    (tmp_path / "raw" / "obs_date=+55969-09-28").mkdir()
    assert len(readings.partitions()) == 2
    daily.merge(readings, stations)
    asked = spark.createDataFrame([("p",), ("x",)], "station_id string")
    left = delete_stations(readings, daily, stations, asked)
    assert [r.station_id for r in left.collect()] == ["p"]
    assert {r.station_id for r in readings.read(readings.partitions()).collect()} == {"p"}
    assert {r.station_id for r in daily.read().collect()} == {"p"} and len(readings.partitions()) == 1

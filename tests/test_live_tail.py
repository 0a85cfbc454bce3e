"""Long ranges go on where the rollup ends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldobs.operators.daily import daily_rollup
from fieldobs.plans.requests import Network
from fieldobs.schema import DAILY_COLUMNS
from fieldobs.sources.store import DailyStore, ReadingStore
from tests.conftest import at

NOW = at("2024-01-30 12:00")


def hourly(make, first, hours, station="s", value=0.0):
    return make.readings(*[{"station_id": station, "observed_at": str(at(first) + dt.timedelta(hours=h)), "temp_c": value + h % 24} for h in range(hours)])


def days(df):
    return {(r.station_id, str(r.day)): r.temp_avg for r in df.select(*DAILY_COLUMNS).collect()}


@pytest.fixture
def stores(spark, tmp_path):
    raw, rollup = ReadingStore(spark, str(tmp_path / "raw")), DailyStore(spark, str(tmp_path / "daily"))

    def merge(seq, rows):
        raw.merge(rows.withColumn("seq", F.lit(seq)), "seq")

    return raw, rollup, merge


def test_stores_tell_what_is_not_rolled_up(make, stores):
    raw, rollup, merge = stores
    stations = make.stations({"station_id": "s", "timezone": "Pacific/Auckland"}, {"station_id": "t"}, {"station_id": "u"})
    assert Network.of_stores(stations, raw, rollup).days(NOW).count() == 0
    merge(1, hourly(make, "2024-01-20 00:00", 24 * 8).unionByName(hourly(make, "2024-01-20 00:00", 24 * 10, "t")))
    rollup.merge(raw, stations)
    net = Network.of_stores(stations, raw, rollup)
    assert days(net.days(NOW)) == days(rollup.read())
    merge(2, hourly(make, "2024-01-28 00:00", 60, value=40.0))  # two days behind
    merge(3, hourly(make, "2024-01-21 02:30", 3, "t", 70.0).unionByName(hourly(make, "2024-01-29 00:00", 5, "u")))  # late, and a new station
    net = Network.of_stores(stations, raw, rollup)
    want = days(daily_rollup(raw.read(), stations))
    assert days(net.days(NOW)) == want != days(rollup.read())
    assert days(net.days(NOW, ["t"])) == {k: v for k, v in want.items() if k[0] == "t"}
    for name in ("1y", "all"):
        assert days(net.station_readings("s", NOW, name).data) == {k: v for k, v in want.items() if k[0] == "s"}
    asked = stations.where("station_id in ('s', 'u')").select("station_id")
    assert net.compare_stations(asked, NOW, "1y").where("day is not null").count() == sum(k[0] in "su" for k in want)


def test_only_touched_dates_are_read(make, stores):
    raw, rollup, merge = stores
    stations = make.stations()
    merge(1, hourly(make, "2024-01-01 00:00", 24 * 20))
    rollup.merge(raw, stations)
    merge(2, hourly(make, "2024-01-30 00:00", 5))
    text = Network.of_stores(stations, raw, rollup).days(NOW)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in text.splitlines() if "obs_date" in line and "Filter" in line]
    assert any("19750" in line or "2024-01-28" in line for line in scans) and not any("2024-01-20" in line for line in scans)


def test_pruned_days_stay_as_rolled_up(make, stores):
    raw, rollup, merge = stores
    stations = make.stations({"station_id": "s", "timezone": "America/Toronto"})
    merge(1, hourly(make, "2024-01-10 00:00", 24 * 10))
    rollup.merge(raw, stations)
    before = days(rollup.read())
    raw.prune(NOW, 15)  # cuts the local day of the 14th
    merge(2, hourly(make, "2024-01-15 00:30", 1, value=90.0))
    got = days(Network.of_stores(stations, raw, rollup).days(NOW))
    assert {k: v for k, v in got.items() if k[1] < "2024-01-15"} == {k: v for k, v in before.items() if k[1] < "2024-01-15"}
    assert {str(k[1]) for k in got} == {str(k[1]) for k in before}


def test_plain_tables_go_on_from_the_last_rolled_day(make):
    rows = hourly(make, "2024-01-20 00:00", 24 * 8).unionByName(hourly(make, "2024-01-25 00:00", 30, "new"))
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"}, {"station_id": "new"}, {"station_id": "none"})
    whole = days(daily_rollup(rows, stations))
    stored = daily_rollup(rows.where("observed_at < timestamp_ntz'2024-01-25 13:00:00' and station_id = 's'"), stations)
    net = Network(stations, rows, stored, live_tail=True)
    assert days(net.days(NOW)) == whole
    assert days(net.station_readings("s", NOW, "1y").data) == {k: v for k, v in whole.items() if k[0] == "s"}
    dated = Network(stations, rows.withColumn("obs_date", F.to_date("observed_at")), stored, live_tail=True)
    assert days(dated.days(NOW, ["s"])) == {k: v for k, v in whole.items() if k[0] == "s"}
    assert days(Network(stations, rows, stored).days(NOW)) == days(stored)

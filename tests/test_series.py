import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldobs.operators import buckets, daily, scan, sunshine
from tests.conftest import at, one


def hours(make, pairs):
    return one(sunshine.sunshine_elapsed(make.series("solar_radiation", pairs))).sunshine_hours


def test_elapsed_sunshine(make):
    day = "2024-01-05"
    assert hours(make, [(f"{day} 10:00", 130.0), (f"{day} 10:10", 130.0), (f"{day} 10:20", 50.0)]) == 0.3
    assert hours(make, [(f"{day} 10:00", 500.0), (f"{day} 14:00", 0.0)]) == 0.5
    assert hours(make, [(f"{day} 10:00", 500.0)]) is None
    assert hours(make, [(f"{day} 10:00", None), (f"{day} 10:10", None)]) is None
    assert hours(make, [(f"{day} 10:00", 120.0), (f"{day} 10:30", 0.0)]) == 0.5
    # A reading without a solar value does not cut the interval.
    assert hours(make, [(f"{day} 10:00", 200.0), (f"{day} 10:10", None), (f"{day} 10:24", 0.0)]) == 0.4


def test_counted_sunshine(make):
    solar = [(f"2024-01-05 10:{m}0", v) for m, v in enumerate([120.0, 300.0, 121.0, 119.0])]
    row = one(daily.sunshine_daily_count(make.series("solar_radiation", solar), make.stations()))
    assert row.sunshine_hours == 0.5


def test_midnight_crossing(make):
    rows = make.series("solar_radiation", [("2024-01-05 23:50", 200.0), ("2024-01-06 00:10", 0.0)])
    by_day = sunshine.sunshine_by_day(rows, make.stations()).orderBy("day").collect()
    assert [r.sunshine_hours for r in by_day] == [None, None]
    series = sunshine.sunshine_series_raw(rows, make.stations()).orderBy("observed_at").collect()
    assert [(str(r.day), r.hours) for r in series] == [("2024-01-05", 0.33), ("2024-01-06", 0.0)]
    six = sunshine.sunshine_series_6h(rows, make.stations()).orderBy("bucket_start").collect()
    assert [(r.bucket_start, r.hours, r.day_label) for r in six] == [
        (at("2024-01-05 18:00"), 0.3, None), (at("2024-01-06 00:00"), 0.0, "Sat 6")]


def test_series_with_one_reading(make):
    rows = make.series("solar_radiation", [("2024-01-05 10:00", 500.0)])
    assert one(sunshine.sunshine_series_raw(rows, make.stations())).hours == 0.0


def test_cumulative_adds_rounded_steps(make):
    start = at("2024-01-05 10:00")
    pairs = [(str(start + dt.timedelta(minutes=10 * i)), 500.0) for i in range(7)]
    got = sunshine.sunshine_cumulative(make.series("solar_radiation", pairs), make.stations()).orderBy("observed_at")
    assert [r.cumulative for r in got.collect()] == [0.2, 0.3, 0.5, 0.7, 0.9, 1.0, 1.0]


@pytest.mark.parametrize("zone", [None, "Asia/Kolkata", "America/Toronto"])
def test_split_lead_equals_brute_force(make, zone):
    """The hour-by-hour form against a plain walk over the sorted readings."""
    rng = random.Random(7)
    moment, pairs = at("2024-03-09 20:00"), []
    for _ in range(400):
        moment += dt.timedelta(seconds=rng.choice([5, 60, 600, 1700, 1900, 4000, 9000]))
        pairs.append((moment, rng.choice([None, 0.0, 119.9, 120.0, 500.0])))
    rows = make.series("solar_radiation", [(str(t), v) for t, v in pairs])
    stations = make.stations({"station_id": "s", "timezone": zone})
    lit = [(t, v) for t, v in pairs if v is not None]
    credit = {t: min((n - t).total_seconds(), 1800) if v >= 120 else 0 for (t, v), (n, _) in zip(lit, lit[1:])}
    credit[lit[-1][0]] = 0
    assert one(sunshine.sunshine_elapsed(rows)).sunshine_hours == round(sum(credit.values()) / 360 + 1e-9) / 10
    got = {r.observed_at: r.credit / 1e6 for r in sunshine.reading_credits(rows, stations).collect()}
    assert got == credit
    local = {r.observed_at: r.local_ts for r in scan.with_local_time(rows, stations).collect()}
    six: dict = {}
    for t, seconds in credit.items():
        start = local[t].replace(hour=local[t].hour // 6 * 6, minute=0, second=0)
        six[start] = six.get(start, 0) + seconds
    sums = {r.bucket_start: r.hours for r in sunshine.sunshine_series_6h(rows, stations).collect()}
    assert sums == {k: int(v / 360 + 0.5 + 1e-9) / 10 for k, v in six.items()}
    totals, day, expected = 0.0, None, {}
    for t in sorted(credit):
        if local[t].date() != day:
            day, totals = local[t].date(), 0.0
        totals += int(credit[t] / 36 + 0.5 + 1e-9) / 100
        expected[t] = int(totals * 10 + 0.5 + 1e-9) / 10
    running = {r.observed_at: r.cumulative for r in sunshine.sunshine_cumulative(rows, stations).collect()}
    assert running == expected


def test_rollup_and_partials_agree(make):
    rng = random.Random(3)
    rows = [{"station_id": s, "observed_at": str(at("2024-03-09 00:00") + dt.timedelta(minutes=7 * i)),
             "temp_c": rng.choice([None, rng.randint(-100, 300) / 10]), "humidity": rng.randint(0, 100),
             "wind_dir": rng.choice([None, rng.randint(0, 359)]), "solar_radiation": rng.choice([None, 0.0, 120.0, 800.0]),
             "precip_total_mm": rng.randint(0, 50) / 20} for s in ("a", "b") for i in range(600)]
    stations = make.stations({"station_id": "a", "timezone": "Pacific/Auckland"}, {"station_id": "b"})
    readings = make.readings(*rows)
    direct = daily.daily_rollup(readings, stations)
    composed = daily.rollup_from_partials(daily.quarter_hour_partials(readings), stations)
    order = ["station_id", "day"]
    assert direct.orderBy(order).collect() == composed.orderBy(order).collect()
    hand = direct.where("station_id = 'b' AND day = DATE'2024-03-09'").first()
    temps = [r["temp_c"] for r in rows[600:] if r["observed_at"] < "2024-03-10" and r["temp_c"] is not None]
    assert hand.temp_max == max(temps) and hand.temp_min == min(temps)


def test_first_day_of_a_range_may_be_partial(make):
    rows = make.series("temp_c", [("2024-01-05 10:00", 1.0), ("2024-01-05 14:00", 3.0)])
    got = one(daily.readings_daily(rows, make.stations(), at("2024-01-05 12:00")))
    assert (got.temp_avg, got.sunshine_hours, got.wind_dir) == (3.0, None, None)


def test_six_hour_buckets_label_midnight_only(make):
    rows = make.series("temp_c", [("2024-01-05 18:40", 1.0), ("2024-01-05 19:00", 2.05)])
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"})
    got = one(buckets.bucket_6h(rows, stations, ["temp_c", "wind_dir"]))
    assert (got.bucket_start, got.label, got.day_label, got.full_label) == (
        at("2024-01-06 00:00"), "00:00", "Sat 6", "Sat 6, 00:00")
    assert got.temp_c == 1.5 and got.wind_dir is None


def test_rose_with_one_sector(make):
    rows = make.series("wind_dir", [(f"2024-01-05 10:0{i}", 90) for i in range(3)])
    got = {r.direction: r.share_pct for r in buckets.wind_rose(rows).collect()}
    assert got == {d: 100.0 if d == "E" else 0.0 for d in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")}


def test_window_is_half_open(make):
    rows = make.series("temp_c", [("2024-01-05 00:00", 1.0), ("2024-01-06 00:00", 2.0)])
    assert one(scan.readings_between(rows, "2024-01-05", "2024-01-06")).temp_c == 1.0


def test_recent_rows_per_station(make):
    pairs = [(str(at("2024-01-05 00:00") + dt.timedelta(hours=9 * i)), float(i)) for i in range(12)]
    rows = make.series("temp_c", pairs, "a").unionByName(make.series("temp_c", pairs[:2], "b"))
    got = scan.recent_n_ascending(rows, 5).collect()
    assert [(r.station_id, r.temp_c) for r in got] == [("a", float(i)) for i in range(7, 12)] + [("b", 0.0), ("b", 1.0)]


def test_availability_and_bounds(make):
    rows = make.series("temp_c", [("2023-01-05 10:00", 1.0), ("2024-01-05 10:00", None)])
    got = one(scan.sensor_availability(rows, ["temp_c", "uv"]))
    assert (got.has_temp_c, got.has_uv) == (True, False)
    ranges = scan.data_range(rows, make.daily({"day": "2022-03-01"}))
    bounds = one(scan.period_bounds(ranges, make.stations(), at("2024-01-30 12:00")))
    assert tuple(map(str, bounds[1:])) == ("2023-11-01", "2022-03-01", "2024-01-05")
    ahead = make.stations({"station_id": "s", "timezone": "Pacific/Auckland"})
    late = scan.data_range(make.series("temp_c", [("2024-01-05 20:00", 1.0)]), make.daily())
    bounds = one(scan.period_bounds(late, ahead, at("2024-01-30 12:00")))
    assert tuple(map(str, bounds[1:])) == ("2024-01-06", "2024-01-06", "2024-01-06")
    only_daily = scan.data_range(make.readings(), make.daily({"day": "2022-03-01"}))
    assert str(one(only_daily).daily_min) == "2022-03-01"
    bounds = one(scan.period_bounds(only_daily, make.stations(), at("2024-01-30 12:00")))
    assert tuple(map(str, bounds[1:])) == ("None", "2022-03-01", "None")


def test_station_order(make):
    stations = make.stations({"station_id": "a", "created_at": "2024-01-02"}, {"station_id": "b"},
                             {"station_id": "p", "is_primary": True, "created_at": "2024-01-09"})
    assert [r.station_id for r in scan.station_list(stations).collect()] == ["p", "b", "a"]


def test_zone_list_is_optional(make):
    stations = make.stations({"station_id": "s", "timezone": "Europe/London"}, {"station_id": "t", "timezone": "Asia/Tokyo"})
    rows = make.series("temp_c", [("2024-07-01 23:30", 1.0)]).unionByName(
        make.series("temp_c", [("2024-07-01 23:30", 1.0)], "t"))
    plain = scan.with_local_time(rows, stations).select("station_id", "local_ts").orderBy("station_id").collect()
    declared = scan.zones_in_use(stations)
    assert declared.schema["timezone"].metadata["zones"] == ["Asia/Tokyo", "Europe/London"]
    assert scan.with_local_time(rows, declared).select("station_id", "local_ts").orderBy("station_id").collect() == plain

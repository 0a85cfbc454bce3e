import datetime as dt

import __spark_entry__ as entry

from fieldobs.operators import compare, summary
from fieldobs.operators.daily import daily_rollup
from fieldobs.plans import timewin
from fieldobs.plans.requests import Network
from tests.conftest import at, one

A = timewin.Period(dt.date(2024, 2, 1), dt.date(2024, 3, 1), "February 2024")
B = timewin.Period(dt.date(2024, 1, 1), dt.date(2024, 2, 1), "January 2024")


def test_periods_align_by_day(make):
    rows = make.daily({"day": "2024-01-01", "temp_avg": 1.0}, {"day": "2024-02-01", "temp_avg": 2.0},
                      {"day": "2024-01-31", "temp_avg": 3.0}, {"day": "2024-03-01", "temp_avg": 9.0})
    got = {r.idx: (r.temp_avg_a, r.temp_avg_b) for r in compare.compare_periods_aligned(rows, A, B).collect()}
    assert got == {1: (2.0, 1.0), 31: (None, 3.0)}


def test_overlapping_periods_count_a_day_twice(make):
    rows = make.daily({"day": "2024-01-15", "temp_avg": 4.0})
    got = one(compare.compare_period_stats(rows, B, B))
    assert (got.temp_avg_a, got.temp_avg_b, got.temp_avg_delta) == (4.0, 4.0, 0.0)


def test_period_stats(make):
    rows = make.daily({"day": "2024-02-01", "temp_avg": 2.0, "precip_total_mm": 1.0},
                      {"day": "2024-02-02", "temp_avg": 3.5, "precip_total_mm": 2.0}, {"day": "2024-01-05", "temp_avg": 1.0})
    got = one(compare.compare_period_stats(rows, A, B))
    assert (got.temp_avg_a, got.temp_avg_b, got.temp_avg_delta) == (2.8, 1.0, 1.8)
    assert (got.precip_total_mm_a, got.precip_total_mm_b, got.precip_total_mm_delta) == (3.0, None, None)


def test_days_compare_on_the_local_clock(make):
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"})
    rows = make.readings({"observed_at": "2024-01-01 18:40", "temp_c": 1.0, "precip_total_mm": 0.5},
                         {"observed_at": "2024-01-02 18:20", "temp_c": 5.0, "precip_total_mm": 2.5},
                         {"observed_at": "2024-01-02 18:40", "temp_c": 9.0, "precip_total_mm": 0.0})
    day = dt.date(2024, 1, 2)
    hourly = compare.compare_days_hourly(rows, stations, day, dt.date(2024, 1, 3)).collect()
    assert {r.idx: (r.temp_avg_a, r.temp_avg_b) for r in hourly} == {0: (1.0, 9.0), 23: (5.0, None)}
    got = one(compare.compare_day_stats(rows, stations, day, dt.date(2024, 1, 3)))
    assert (got.temp_avg_a, got.precip_total_mm_a, got.temp_avg_delta) == (3.0, 2.5, -6.0)


def test_requested_stations(spark, make):
    asked = spark.createDataFrame([("s",), ("ghost",)], "station_id string")
    series = make.daily({"day": "2024-01-01", "temp_avg": 1.0})
    got = {r.station_id: (r["name"], r.temp_avg) for r in compare.compare_stations(
        asked, make.stations(), series, ["temp_avg"]).collect()}
    assert got == {"s": ("S", 1.0), "ghost": ("ghost", None)}


def test_pivot_days_and_band(make):
    rows = make.daily({"station_id": "a", "day": "2024-01-01", "temp_min": 1.0, "temp_max": 3.0},
                      {"station_id": "b", "day": "2024-01-02", "temp_min": 2.0})
    got = {str(r.day): (r.s0, r.s1) for r in compare.multi_station_pivot(rows, ["a", "b"], "temp_min").collect()}
    assert got == {"2024-01-01": (1.0, None), "2024-01-02": (None, 2.0)}
    assert compare.distinct_days(rows, rows).count() == 2
    assert [r.band for r in compare.temp_band(rows).orderBy("day").collect()] == [[1.0, 3.0], None]


def test_station_table(make):
    rows = make.daily({"day": "2024-01-01", "temp_max": 1.0, "sunshine_hours": 2.5}, {"day": "2024-01-02", "temp_max": 4.0, "sunshine_hours": 1.0})
    got = one(compare.compare_stations_table(rows))
    assert (got.temp_max, got.sunshine_hours, got.temp_avg) == (4.0, 3.5, None)


def comparison(make, *rows):
    stats = compare.compare_summary_stats(make.daily(*rows), A, B)
    return one(compare.summary_comparison_text(stats, A.label, B.label)).lines


def test_comparison_sentences(make):
    assert comparison(make, {"day": "2024-02-01", "temp_avg": 3.0, "precip_total_mm": 2.0, "wind_speed_kph": 9.0},
                      {"day": "2024-01-01", "temp_avg": 1.5, "precip_total_mm": 5.0, "wind_speed_kph": 8.8}) == [
        "February 2024 averaged 3°C — 1.5°C warmer than January 2024 (1.5°C).",
        "Rainfall totalled 2 mm vs 5 mm — 3 mm less.",
        "Average wind 9 km/h vs 8.8 km/h — similar winds."]
    assert comparison(make, {"day": "2024-02-01", "temp_avg": 3.04}, {"day": "2024-01-01", "temp_avg": 3.0}) == [
        "February 2024 averaged 3°C — about the same temperature as January 2024 (3°C).",
        "Rainfall totalled 0 mm vs 0 mm — a similar amount."]
    assert comparison(make, {"day": "2024-02-01", "temp_avg": 3.0, "precip_total_mm": 1.0}) == [
        "February 2024 averaged 3°C (no comparison data for January 2024 yet).", "Rainfall totalled 1 mm."]


def daily_lines(make, *rows):
    return one(summary.summary_daily_text(summary.summary_daily_stats(make.daily(*rows)), "the month")).lines


def test_daily_sentences(make):
    assert daily_lines(
        make, {"day": "2024-01-02", "temp_avg": 2.0, "temp_max": 8.0, "temp_min": 0.0, "wind_gust_kph": 30.0, "sunshine_hours": 2.0, "precip_total_mm": 0.2},
        {"day": "2024-01-01", "temp_avg": 3.0, "temp_max": 8.0, "temp_min": -1.0, "wind_gust_kph": 30.0, "precip_total_mm": 0.3}) == [
        "Averaged 2.5°C over the month. Warmest 8°C (1 Jan), coldest -1°C (1 Jan).",
        "0.5 mm of rain across 1 day.", "Windiest day peaked at 30 km/h (1 Jan).",
        "2 hours of sunshine, averaging 2 h/day."]
    assert daily_lines(make, {"day": "2024-01-02"}) == ["No measurable rain."]


def test_rain_from_a_daily_gauge(make):
    rows = make.series("precip_total_mm", [("2024-01-01 01:00", 0.0), ("2024-01-01 02:00", 2.0), ("2024-01-01 03:00", 3.5),
                                           ("2024-01-02 01:00", 0.1)])
    got = one(summary.rainfall_window(rows, make.stations()))
    assert (got.rain_total, got.wet_days) == (3.6, 1)
    edge = make.series("precip_total_mm", [("2024-01-01 01:00", 0.2)])
    assert one(summary.rainfall_window(edge, make.stations())).wet_days == 0
    assert summary.rainfall_window(make.series("temp_c", [("2024-01-01 01:00", 1.0)]), make.stations()).count() == 0


def test_pressure_trend(make):
    def trend(*values):
        pairs = [(f"2024-01-01 0{i}:00", v) for i, v in enumerate(values)]
        row = one(summary.pressure_trend(make.series("pressure_mb", pairs)))
        return row.pressure_change, row.trend

    assert trend(1010.0, None, 1010.9) == (0.9, "steady")
    assert trend(1010.0, 1030.0, 1011.0) == (1.0, "rising")
    assert trend(1010.0, 1009.0) == (-1.0, "falling")
    assert trend(1010.0) == (None, None)


def test_period_sentences(make):
    rows = make.readings(
        {"observed_at": "2024-01-01 09:00", "temp_c": 1.0, "pressure_mb": 1000.0, "solar_radiation": 500.0, "wind_gust_kph": 9.0},
        {"observed_at": "2024-01-01 09:30", "temp_c": 4.0, "precip_total_mm": 0.5, "solar_radiation": 500.0},
        {"observed_at": "2024-01-01 10:00", "temp_c": 4.0, "pressure_mb": 1001.5, "solar_radiation": 0.0})
    stats = summary.summary_period_stats(rows, make.stations())
    assert one(summary.summary_period_text(stats, "the day")).lines == [
        "Average 3°C in the day. High of 4°C (Mon 09:30), low of 1°C (Mon 09:00).",
        "0.5 mm of rain across 1 wet day.", "Peak gust 9 km/h.", "1 hour of sunshine.",
        "Pressure rising (+1.5 hPa)."]


def test_tied_days_go_to_the_earlier(make):
    rows = make.daily({"day": "2024-01-02", "temp_max": 5.0}, {"day": "2024-01-01", "temp_max": 5.0})
    assert str(one(summary.extreme_day(rows, "temp_max")).day) == "2024-01-01"


def test_requests_route_by_range(make):
    readings = make.series("temp_c", [("2024-01-29 23:00", 1.0), ("2024-01-30 01:00", 2.0), ("2024-01-02 01:00", 3.0)])
    daily = make.daily({"day": "2023-06-01", "temp_avg": 9.0})
    net = Network(make.stations(), readings, daily)
    now = at("2024-01-30 12:00")
    assert [r.temp_c for r in net.station_readings("s", now, "today").data.collect()] == [2.0]
    assert [r.temp_c for r in net.station_readings("s", now, "7d").data.collect()] == [1.0, 2.0]
    assert [r.temp_c for r in net.station_readings("s", now, "7d", limit=1).data.collect()] == [2.0]
    month = net.station_readings("s", now, "30d")
    assert (month.mode, [r.temp_avg for r in month.data.collect()]) == ("daily", [3.0, 1.0, 2.0])
    year = net.station_readings("s", now, "1y")
    assert (year.mode, [r.temp_avg for r in year.data.collect()]) == ("daily", [9.0])
    assert one(year.latest).temp_c == 2.0
    window = net.station_readings("s", now, window=("2024-01-02", "2024-01-03"))
    assert [r.temp_c for r in window.data.collect()] == [3.0]
    assert net.compare_stations(readings.select("station_id").distinct(), now, "7d").count() == 2
    assert net.compare_stations(readings.select("station_id").distinct(), now, "1y").count() == 1
    assert net.overview(now).count() == 1 and net.regions(now).count() == 1
    assert net.health(now)[0].first().status == "unhealthy"
    assert net.data_range().count() == 1 and net.station_list().count() == 1
    assert net.summarise_window(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), "x").count() == 1
    assert net.summarise_days(dt.date(2023, 1, 1), dt.date(2024, 1, 1), "x").count() == 1
    assert set(net.compare_periods(A, B)) == {"aligned", "stats", "text"}
    assert net.compare_days(dt.date(2024, 1, 29), dt.date(2024, 1, 30))["stats"].count() == 1


def test_presets_and_anchors_give_the_query_s_windows(spark):
    """The plain functions against the column form, for every day orders were placed on."""
    for row in entry.queries()["preset_windows"](spark, "/root/testdata/sf0.001").collect():
        a, before = timewin.preset_periods("mom", row.day)
        assert (a.start, a.end, a.label) == (row.a_from, row.a_to, row.a_label)
        assert (before.start, before.end, before.label) == (row.mom_from, row.mom_to, row.mom_label)
        _, last_year = timewin.preset_periods("momYoY", row.day)
        assert (last_year.start, last_year.end, last_year.label) == (row.mom_yoy_from, row.mom_yoy_to, row.mom_yoy_label)
        year, past = timewin.preset_periods("yoy", row.day)
        assert (year.start, past.start, past.end) == (row.year_from, row.yoy_from, row.yoy_to)
        assert timewin.default_anchors("day", row.day)[1] == str(row.day_anchor)
        assert timewin.default_anchors("week", row.day)[1] == str(row.week_anchor)
        assert timewin.default_anchors("month", row.day)[1] == row.month_anchor


def test_chart_series_by_range(make, spark):
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"})
    rows = make.series("temp_c", [(f"2024-01-{d:02d} {h:02d}:00", float(d)) for d in range(1, 31) for h in (1, 13)])
    net = Network(stations, rows, daily_rollup(rows, stations))
    kinds = {name: net.chart_series("s", at("2024-01-30 14:00"), name, ("temp_c",)) for name in ("today", "7d", "30d", "1y")}
    assert {n: a.mode for n, a in kinds.items()} == {"today": "raw", "7d": "6h", "30d": "daily", "1y": "daily"}
    assert kinds["today"].data.columns == ["station_id", "observed_at", "temp_c"] and kinds["today"].data.count() == 2
    assert kinds["7d"].data.where("temp_c = 30.0").count() == 2 and kinds["1y"].data.columns == ["station_id", "day", "temp_avg"]

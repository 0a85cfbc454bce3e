import datetime as dt

from pyspark.sql import functions as F

from fieldobs.operators import latest, network, scan
from tests.conftest import at, one

NOW = at("2024-01-30 12:00")


def cards(make, stations, *readings):
    return latest.station_cards(stations, make.readings(*readings), NOW)


def test_staleness_by_source(make):
    stations = make.stations({"station_id": "d", "source": "weathercloud"}, {"station_id": "p"},
                             {"station_id": "edge"}, {"station_id": "none"})
    rows = make.readings(
        {"station_id": "d", "observed_at": "2024-01-30 10:00"}, {"station_id": "p", "observed_at": "2024-01-30 11:29"},
        {"station_id": "edge", "observed_at": "2024-01-30 11:30"})
    stale = {r.station_id: r.issue for r in latest.stale_stations(stations, rows, NOW).collect()}
    assert stale == {"p": "P (p): no data in last 30 minutes", "none": "NONE (none): no data in last 30 minutes"}
    health = one(latest.network_health(stations, rows, NOW))
    assert (health.stations, health.stale, health.status) == (4, 2, "unhealthy")
    assert one(latest.network_health(stations.where("station_id = 'd'"), rows, NOW)).status == "healthy"
    assert one(latest.network_health(stations.where("false"), rows, NOW)).status == "error"


def test_latest_row_and_missing_station(make):
    rows = make.readings({"station_id": "s", "observed_at": "2024-01-30 10:00", "temp_c": 1.0},
                         {"station_id": "s", "observed_at": "2024-01-30 11:00", "uv": 2.0},
                         {"station_id": "s", "observed_at": "2024-01-30 13:00", "temp_c": 9.0})
    row = one(latest.latest_per_station(rows, NOW))
    assert (row.observed_at, row.temp_c, row.uv) == (at("2024-01-30 11:00"), None, 2.0)
    both = latest.with_latest(make.stations({"station_id": "s"}, {"station_id": "x"}), rows, NOW, "uv")
    assert {r.station_id: r.uv for r in both.collect()} == {"s": 2.0, "x": None}


def test_today_starts_at_the_station_midnight(make):
    stations = make.stations({"station_id": "s", "timezone": "Asia/Kolkata"})
    got = one(cards(
        make, stations,
        {"observed_at": "2024-01-29 18:29", "temp_c": 40.0, "wind_gust_kph": 99.0, "precip_total_mm": 9.0},
        {"observed_at": "2024-01-29 18:30", "temp_c": 1.0, "wind_speed_kph": 4.0, "solar_radiation": 500.0},
        {"observed_at": "2024-01-29 18:50", "temp_c": 2.0, "solar_radiation": 0.0},
        {"observed_at": "2024-01-30 11:30", "temp_c": 3.0, "wind_speed_kph": 8.0, "wind_gust_kph": 20.0}))
    assert (got.temp_high, got.temp_low, got.temp_mean, got.gust) == (3.0, 1.0, 2.0, 20.0)
    assert (got.wind_mean, got.avg_wind_kph, got.sunshine, got.rain) == (6.0, 8.0, 0.3, None)
    assert got.summary == "High 3° / low 1° · gusts to 20 km/h"


def test_trailing_hour_reaches_back_past_midnight(make):
    got = one(latest.station_cards(make.stations(), make.readings(
        {"observed_at": "2024-01-29 23:40", "wind_speed_kph": 10.0, "temp_c": 9.0},
        {"observed_at": "2024-01-30 00:10", "wind_speed_kph": 20.0, "temp_c": 1.0}), at("2024-01-30 00:20")))
    assert (got.avg_wind_kph, got.wind_mean, got.temp_high) == (15.0, 20.0, 1.0)


def test_rain_is_the_latest_gauge_even_from_an_earlier_day(make):
    got = one(cards(make, make.stations(), {"observed_at": "2024-01-20 10:00", "precip_total_mm": 7.25}))
    assert (got.rain, got.temp_high, got.summary) == (7.25, None, "7.3 mm rain")
    empty = one(latest.station_cards(make.stations(), make.readings({"station_id": "x", "observed_at": "2024-01-30 11:00"}), NOW))
    assert (empty.observed_at, empty.summary) == (None, None)


def test_current_conditions(make):
    rows = make.readings({"observed_at": "2024-01-30 10:00", "feels_like_c": 3.0, "humidity": 40,
                          "wind_speed_kph": 0.0, "wind_dir": 22})
    got = one(latest.current_conditions(rows))
    assert (got.conditions, got.calm, got.bearing) == ("Feels like 3° · Humidity 40% · Wind 0 km/h NNE", True, "Calm")


def network_cards(spark):
    rows = [("a", "A", "X", True, "2024-01-01", 5.0, 10.0, 2.0, 0.0), ("b", "B", "X", False, "2024-01-02", 7.0, 12.0, 2.0, 3.0),
            ("c", "C", None, False, "2024-01-03", 6.0, 12.0, -1.0, 0.0), ("d", "D", "Y", False, "2024-01-04", None, None, None, None)]
    return spark.createDataFrame(
        [(i, n, c, p, at(t), NOW if m else None, m, h, lo, g) for i, n, c, p, t, m, h, lo, g in rows],
        "station_id string, name string, country string, is_primary boolean, created_at timestamp_ntz, "
        "observed_at timestamp_ntz, temp_mean double, temp_high double, temp_low double, gust double").withColumns({
            "rain": F.when(F.col("station_id") != "d", F.lit(0.0)), "sunshine": F.lit(None).cast("double"),
            "wind_mean": F.col("gust")})


def test_superlatives_break_ties_by_listing(spark):
    got = {r.label: (r.value, r.sub) for r in network.network_highlights(network_cards(spark)).collect()}
    assert got == {"Hottest": ("12°", "B · X"), "Coolest": ("-1°", "C · Other"), "Strongest gust": ("3 km/h", "B · X"),
                   "Biggest swing": ("13°", "C · Other")}


def test_regions(spark):
    got = {r.region: r for r in network.region_stats(network_cards(spark)).collect()}
    assert (got["X"].station_count, got["X"].avg_temp, got["X"].warmest, got["X"].windiest) == (2, 6.0, "B", "B")
    assert (got["Y"].station_count, got["Y"].avg_temp, got["Y"].warmest) == (0, None, None)
    lines = {r.region: r.headline for r in network.region_headline(network.region_stats(network_cards(spark))).collect()}
    assert lines == {"X": "2 stations · avg 6° (today) · warmest B 12° · windiest B 3 km/h",
                     "Other": "1 station · avg 6° (today)", "Y": "0 stations"}


def test_warmest_region_needs_two(spark):
    cards = network_cards(spark)
    # X and Other tie at 6.0: the region listed first wins.
    assert one(network.warmest_region(cards)).region == "X"
    assert network.warmest_region(cards.where("country = 'X'")).count() == 0


def test_region_order(make):
    stations = make.stations({"station_id": "1", "country": "Chile", "is_primary": True}, {"station_id": "2", "country": "Austria"},
                             {"station_id": "3"}, {"station_id": "4", "country": "Zambia"})
    assert [r.region for r in network.region_order(stations).collect()] == ["Chile", "Austria", "Zambia", "Other"]


def test_days_longer_than_25_hours(make):
    """Casey, Antarctica, had 27 hours on 2023-03-09."""
    stations = make.stations({"station_id": "s", "timezone": "Antarctica/Casey"})
    pairs = [(str(at("2023-03-08 12:00") + dt.timedelta(minutes=30 * i)), 1.0) for i in range(90)]
    rows = make.series("temp_c", pairs)
    as_of = at("2023-03-09 15:30")
    whole = scan.with_local_time(rows, stations).where("local_day = '2023-03-09'").where(F.col("observed_at") <= F.lit(str(as_of)).cast("timestamp_ntz"))
    assert scan.today_so_far(rows, stations, as_of).count() == whole.count() > 50

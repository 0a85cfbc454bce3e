import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldobs.functions import clock, geo, text, wind
from fieldobs.functions.rounding import js_round, pg_round
from fieldobs.operators import ingest, scan
from fieldobs.plans import timewin as w
from tests.conftest import at, one


def values(spark, column, rows, kind="double"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
            .orderBy("i").select(column).collect()]


def test_rounding_rules_differ_on_negative_halves(spark):
    x = F.col("x")
    assert values(spark, js_round(x, 1), [-0.25, 0.25, 2.25, None]) == [-0.2, 0.3, 2.3, None]
    assert values(spark, pg_round(x, 1), [-0.25, 0.25, 2.25, None]) == [-0.3, 0.3, 2.3, None]


def test_circular_mean(spark):
    def mean(*degrees):
        df = spark.createDataFrame([(d,) for d in degrees], "d int")
        return one(df.agg(wind.circular_mean(F.col("d")), wind.circular_mean_int(F.col("d"))))

    assert tuple(mean(350, 10)) == (0.0, 0)
    assert tuple(mean(0, 180)) == (0.0, 0)
    assert tuple(mean(90, 270)) == (0.0, 0)
    assert tuple(mean(None, None)) == (None, None)
    assert mean(359, 0)[0] == 359.5 and mean(359, 0)[1] == 0


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 359), min_size=1, max_size=8), st.integers(0, 359))
def test_circular_mean_turns_with_its_input(spark, degrees, turn):
    east = sum(math.sin(math.radians(d)) for d in degrees)
    north = sum(math.cos(math.radians(d)) for d in degrees)
    if math.hypot(east, north) < 1e-6:
        return
    rows = [(d, (d + turn) % 360) for d in degrees]
    a, b = one(spark.createDataFrame(rows, "a int, b int").agg(
        wind.circular_mean(F.col("a")), wind.circular_mean(F.col("b"))))
    gap = abs(((a + turn) - b + 180) % 360 - 180)
    assert gap < 1e-5 and 0 <= b < 360


def test_compass_and_calm(spark):
    assert values(spark, wind.compass(F.col("x")), [359.0, 11.25, 0.0, None]) == ["N", "NNE", "N", "—"]
    df = spark.createDataFrame([(90, 0.0), (90, 1.0), (90, None)], "d int, s double")
    assert [r[0] for r in df.select(wind.bearing_label(F.col("d"), F.col("s"))).collect()] == ["Calm", "E", "E"]


def test_feels_like_chain(spark):
    df = spark.createDataFrame([(None, 31.0, 29.0), (2.0, 31.0, 29.0), (None, None, 29.0)], "w double, h double, t double")
    got = [r[0] for r in df.select(ingest.feels_like(F.col("w"), F.col("h"), F.col("t"))).collect()]
    assert got == [31.0, 2.0, 29.0]


def test_local_days_and_buckets(spark):
    rows = [("2024-03-10 03:30", "America/Toronto"), ("2024-01-01 18:40", "Asia/Kolkata"), ("2024-01-01 18:40", None)]
    df = spark.createDataFrame([(i, at(t), z) for i, (t, z) in enumerate(rows)], "i int, t timestamp_ntz, z string")
    for zones in ([], ["America/Toronto"], ["America/Toronto", "Asia/Kolkata"]):
        local = df.orderBy("i").withColumn("l", clock.to_local(F.col("t"), F.col("z"), zones))
        got = local.select(F.col("l"), clock.six_hour_start(F.col("l"))).collect()
        assert [r[0] for r in got] == [at("2024-03-09 22:30"), at("2024-01-02 00:10"), at("2024-01-01 18:40")]
        assert [r[1] for r in got] == [at("2024-03-09 18:00"), at("2024-01-02 00:00"), at("2024-01-01 18:00")]


def test_local_midnight_on_a_clock_change(spark):
    got = one(spark.range(1).select(clock.local_midnight(
        clock.instant("2024-09-29 00:00:00"), F.lit("Pacific/Auckland")).alias("m")))
    assert got.m == at("2024-09-28 12:00")


def test_relative_labels(spark):
    now = at("2024-01-30 12:00")
    ages = {0.4: "just now", 3: "3 min ago", 59: "59 min ago", 59.6: "1 hr ago", 100: "2 hr ago",
            60 * 23.4: "23 hr ago", 60 * 24: "1 day ago", 60 * 24 * 5: "5 days ago"}
    rows = [(i, now - dt.timedelta(minutes=m)) for i, m in enumerate(ages)]
    df = spark.createDataFrame(rows, "i int, t timestamp_ntz").orderBy("i")
    assert [r[0] for r in df.select(clock.relative_label(F.col("t"), now)).collect()] == list(ages.values())


def test_clock_label_needs_a_zone(spark):
    df = spark.createDataFrame([(0, "Europe/London"), (1, None)], "i int, z string").orderBy("i")
    assert [r[0] for r in df.select(clock.clock_label(F.col("z"), "2024-07-01 12:05:00")).collect()] == ["13:05", None]


def test_number_text(spark):
    assert values(spark, text.number_text(F.col("x")), [3.0, 3.5, 0.0, None, 10.0]) == ["3", "3.5", "0", None, "10"]


def test_page_coordinates(spark):
    def page(body):
        return f'<html><div id="profile-coordinates" class="x">{body}</div><div>1 2 3 N</div></html>'

    pages = [page("45&deg; 53' 6\" N&nbsp; 82&deg; 34' 4\" W"), page("45&deg; 53' 6\" S&nbsp; 82&deg; 34' 4\" E"),
             page("45&deg; 53' 6\" N"), "<html>no block 45° 53' 6\" N 82° 34' 4\" W</html>"]
    got = values(spark, geo.page_coordinates(F.col("x")), pages, "string")
    assert got[0].asDict() == {"latitude": 45.885, "longitude": -82.56778}
    assert got[1].asDict() == {"latitude": -45.885, "longitude": 82.56778}
    assert got[2:] == [None, None]


def test_bounding_box(spark):
    df = spark.createDataFrame([(45.885, -82.56778), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(geo.bounding_box(F.col("a"), F.col("b"))).collect()]
    assert got == ["-82.58778,45.86500,-82.54778,45.90500", None]


def test_periods():
    day = dt.date
    assert w.week_period(day(2024, 1, 7)) == w.Period(day(2024, 1, 1), day(2024, 1, 8), "Week of 1 January")
    a, b = w.preset_periods("mom", day(2024, 1, 15))
    assert (a.start, a.end) == (day(2024, 1, 1), day(2024, 2, 1))
    assert (b.start, b.end, b.label) == (day(2023, 12, 1), day(2024, 1, 1), "December 2023")
    a, b = w.preset_periods("momYoY", day(2024, 2, 29))
    assert (b.start, b.end) == (day(2023, 2, 1), day(2023, 3, 1))
    a, b = w.preset_periods("yoy", day(2024, 2, 29))
    assert (a.label, b.label, b.start) == ("2024", "2023", day(2023, 1, 1))
    assert w.default_anchors("month", day(2024, 1, 15)) == ("2024-01", "2023-12")
    assert w.default_anchors("week", day(2024, 1, 15)) == ("2024-01-15", "2024-01-08")
    assert w.default_anchors("day", day(2024, 1, 1)) == ("2024-01-01", "2023-12-31")
    assert w.default_anchors("year", day(2024, 1, 1)) == ("2024", "2023")
    assert w.anchored_period("month", "2024-02").end == day(2024, 3, 1)
    assert w.anchor_is_valid("year", "2024") and not w.anchor_is_valid("month", "2024-1")


def test_ranges():
    now = at("2024-01-30 12:00")
    assert w.range_start("7d", now) == at("2024-01-23 12:00")
    assert w.range_start("all", now) == at("1970-01-01")
    assert w.range_start("bogus", now) == at("2024-01-29 12:00")
    assert w.comparison_range("bogus") == "30d"
    assert w.comparison_range_start("1y", now) == now - dt.timedelta(days=365)
    for bad in (("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-01"), ("x", "2024-01-01")):
        try:
            w.checked_window(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_station_id_lists(spark):
    a, b = "0b5a2e9c-6f0e-4f0e-9d3a-0123456789ab", "0B5A2E9C-6F0E-4F0E-9D3A-0123456789AC"
    assert scan.parse_station_ids(f"{a}, {a},,{b}") == [a, b]
    for bad in ("", "not-an-id", ",".join(a[:-1] + d for d in "01234")):
        try:
            scan.parse_station_ids(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    texts = [f"{a}, {a},,{b}", "", ",".join(a[:-1] + d for d in "01234"), "zzz"]
    ids = scan.station_ids(F.col("x"))
    assert values(spark, ids, texts, "string")[0] == [a, b]
    assert values(spark, scan.station_ids_valid(ids), texts, "string") == [True, False, False, False]


def test_outliers_round_to_null(spark):
    row = one(spark.createDataFrame([(1e25, 2.25, float("nan"))], "a double, b double, c double").select(
        js_round(F.col("a"), 1).alias("a"), pg_round(F.col("a"), 1).alias("p"), js_round(F.col("b"), 1).alias("b"),
        js_round(F.col("c"), 1).alias("c")))
    assert tuple(row) == (None, None, 2.3, None)


def test_windows_with_an_offset():
    assert w.checked_window("2024-01-10T00:00+02:00", "2024-01-11T00:00+02:00") == ("2024-01-09 22:00:00", "2024-01-10 22:00:00")
    with pytest.raises(ValueError):
        w.checked_window("2024-01-10T00:00+02:00", "2024-01-11")
    with pytest.raises(ValueError):
        w.checked_window("2024-01-10T00:00+02:00", "2024-01-09T21:00Z")


def test_coordinate_blocks(spark):
    def page(text):
        return f'<html><p id="x">9 9 9 N</p><div class="c" id="profile-coordinates" data-x="1">{text}</div><p>1 1 1 S 2 2 2 W</p>'

    texts = ["45&deg; 53' 6\" N&nbsp; 82&deg; 34' 4\" W", "45&#176; 53&#39; 6&quot; S <b>82</b>° 34' 4.5\" E", "0° 0' 0\" N 0° 0' 0\" E",
             "45° 53' N 82° 34' 4\" W", "45° 53' 6\" N", "", "Elevation 12 m, 45° 53' 6\" N 82° 34' 4\" W"]
    rows = spark.createDataFrame([(i, page(t)) for i, t in enumerate(texts)] + [(7, None), (8, "<p>45 53 6 N 82 34 4 W</p>")], "i int, html string")
    got = {r.i: r.p and tuple(r.p) for r in rows.select("i", geo.page_coordinates(F.col("html")).alias("p")).collect()}
    assert got == {0: (45.885, -82.56778), 1: (-45.885, 82.56792), 2: (0.0, 0.0), 3: None, 4: None, 5: None, 6: (45.885, -82.56778), 7: None, 8: None}

import json

from fieldobs.operators import ingest, quality
from fieldobs.schema import READING_COLUMNS
from tests.conftest import at, one


def payloads(spark, *texts, **extra):
    return spark.createDataFrame([("s", t) for t in texts], "station_id string, payload string")


def test_device_payload(spark):
    text = json.dumps({"epoch": 1704067200, "temp": 5.5, "hum": 44.6, "wspdavg": 12, "wspd": None, "wdiravg": 90, "heat": 7})
    got = one(ingest.ingest_device(payloads(spark, text)))
    assert list(got.asDict()) == READING_COLUMNS
    assert (got.observed_at, got.temp_c, got.humidity) == (at("2024-01-01 00:00"), 5.5, 45)
    assert (got.wind_speed_kph, got.wind_dir, got.feels_like_c, got.elevation) == (12.0, 90, 7.0, None)


def test_device_rejects(spark):
    bad = ["not json", ' {"epoch":1}', '{"epoch":"x"}', '{"epoch":"17"}', '{"temp":1}', '{"epoch":1} tail', '{"epoch":1e300}', "", None]
    rows = payloads(spark, *bad, '{"epoch":1}')
    assert ingest.rejected_device(rows).count() == len(bad)
    assert one(ingest.ingest_device(rows)).observed_at == at("1970-01-01 00:00:01")


def test_pws_payload(spark):
    first = {"stationID": "I1", "obsTimeUtc": "2024-01-01T10:00:00Z", "winddir": 350, "humidity": 40, "uv": 1.5,
             "metric": {"temp": 5.5, "windChill": None, "heatIndex": 6.5, "elev": 120}}
    second = {**first, "obsTimeUtc": "2024-01-01T11:00:00Z"}
    rows = payloads(spark, json.dumps({"observations": [first, second]}), '{"observations":[]}', "{}", "junk", None,
                    '{"observations":[{"obsTimeUtc":"noon"}]}')
    got = one(ingest.ingest_pws(rows))
    assert (got.observed_at, got.wind_dir, got.feels_like_c, got.elevation) == (at("2024-01-01 10:00"), 350, 6.5, 120.0)
    assert (got.temp_indoor_c, got.humidity_indoor) == (None, None)
    assert ingest.rejected_pws(rows).count() == 5


def test_indoor_feed_serves_the_primary_station(spark, make):
    batch = spark.createDataFrame([("p", 1, 5.0, 50), ("p", 2, 6.0, 60), ("x", 1, 7.0, 70)],
                                  "station_id string, poll_id int, temp_indoor_c double, humidity_indoor int")
    feed = spark.createDataFrame([("p", 1, 20.0, None), ("x", 1, 99.0, 99)], batch.schema)
    stations = make.stations({"station_id": "p", "is_primary": True}, {"station_id": "x"})
    got = {(r.station_id, r.poll_id): (r.temp_indoor_c, r.humidity_indoor) for r in ingest.indoor_enrich(batch, feed, stations).collect()}
    assert got == {("p", 1): (20.0, None), ("p", 2): (6.0, 60), ("x", 1): (7.0, 70)}


def test_outcomes(make):
    stations = make.stations({"station_id": "a"}, {"station_id": "b"}, {"station_id": "c", "source": "weathercloud"},
                             {"station_id": "d", "source": "weathercloud", "source_id": "77"})
    rows = make.readings({"station_id": "a", "observed_at": "2024-01-01 00:00"})
    got = {r.station: r.status for r in ingest.collect_outcomes(stations, rows).collect()}
    assert got == {"a": "ok", "b": "no_data", "77": "no_data"}
    assert one(ingest.any_stored(ingest.collect_outcomes(stations, rows))).any_stored is True
    failed = ingest.collect_outcomes(stations, rows, stored=False)
    assert one(ingest.any_stored(failed)).asDict() == {"any_stored": False, "ok": 0, "no_data": 0, "error": 3}


def test_station_requests(spark):
    asked = [(" A ", "weathercloud", " cyze "), ("B", "weathercloud", "abc123"), ("C", "elsewhere", "ikings1"),
             ("D", None, "x"), ("  ", "weathercloud", "abcd"), ("E", "wunderground", " ")]
    got = ingest.station_conform(spark.createDataFrame(asked, "name string, source string, station_id string"))
    assert [tuple(r) for r in got.orderBy("name").collect()] == [
        ("A", "weathercloud", "CYZE", "WC-CYZE"), ("B", "weathercloud", "abc123", "WC-abc123"),
        ("C", "wunderground", "IKINGS1", "IKINGS1"), ("D", "wunderground", "X", "X")]


def test_unknown_zones_become_utc(spark, make):
    stations = make.stations({"station_id": "a", "timezone": "Mars/Olympus"}, {"station_id": "b", "timezone": "Asia/Tokyo"}, {"station_id": "c"})
    got = {r.station_id: (r.timezone, r.zone_valid) for r in quality.tz_validate(stations, quality.known_zones(spark)).collect()}
    assert got == {"a": (None, False), "b": ("Asia/Tokyo", True), "c": (None, True)}


def test_geo_backfill(spark, make):
    stations = make.stations(
        {"station_id": "full", "latitude": 1.5, "longitude": 2.5, "timezone": "Asia/Tokyo", "country": "J"},
        {"station_id": "coords", "timezone": "Asia/Tokyo", "country": "Old"},
        {"station_id": "zone", "latitude": 1.5, "longitude": 2.5},
        {"station_id": "ocean", "latitude": 50.5, "longitude": 2.5},
        {"station_id": "lost", "timezone": "Asia/Tokyo", "country": "J"})
    found = spark.createDataFrame([("coords", 1.2, 2.9), ("zone", 9.0, 9.0)], "station_id string, latitude double, longitude double")
    cells = spark.createDataFrame([(1, 2, "Africa/Lagos")], "cell_lat int, cell_lon int, timezone string")
    countries = spark.createDataFrame([("Africa/Lagos", "Nigeria")], "timezone string, country string")
    targets = quality.geo_backfill(stations, found, cells, countries)
    got = {r.station_id: (r.latitude, r.timezone, r.country, r.updated) for r in targets.collect()}
    assert got == {"coords": (1.2, "Africa/Lagos", "Nigeria", True), "zone": (1.5, "Africa/Lagos", "Nigeria", True),
                   "ocean": (50.5, None, None, True), "lost": (None, "Asia/Tokyo", "J", False)}
    assert one(quality.backfill_report(targets)).asDict() == {"checked": 4, "updated": 3, "misses": 1}
    assert quality.apply_backfill(stations, targets).count() == 5


def test_strict_payloads(spark):
    """What a JSON parser refuses, or more than one object, is no payload."""
    bad = ['{"epoch":1704067200,"temp":NaN}', "{'epoch':1704067200}", '{"epoch":1704067200}{"epoch":1}',
           '{"epoch":1704067200},{"epoch":1704067200}', '{"epoch":1704067200,}', '{"epoch":1704067200000}', '{"epoch":-5}']
    rows = payloads(spark, *bad, '{"epoch":1704067200,"temp":1e25,"hum":5}')
    got = one(ingest.ingest_device(rows))
    assert (got.temp_c, got.humidity) == (None, 5)
    assert {r.payload for r in ingest.rejected_device(rows).collect()} == set(bad)


def test_every_landed_row_is_accounted_for(spark):
    good = '{"epoch":1704067200,"temp":1.0}'
    rows = spark.createDataFrame([("d", "weathercloud", 1, good), ("d", None, 2, good), ("p", "wunderground", 3, "x"), ("p", "other", 4, good)],
                                 "station_id string, source string, ingest_seq long, payload string")
    assert ingest.ingest_mixed(rows).count() == 1 and ingest.rejected_mixed(rows).count() == 3
    intake = ingest.Intake(rows)
    assert intake.accepted("ingest_seq").count() == 1 and {r.ingest_seq for r in intake.rejected().collect()} == {2, 3, 4}
    intake.close()

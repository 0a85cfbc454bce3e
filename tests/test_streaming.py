import json

from pyspark.sql import functions as F

from fieldobs.operators.daily import daily_rollup, quarter_hour_partials, rollup_from_partials
from fieldobs.session import work_dir
from fieldobs.sources.store import LatestStore, ReadingStore
from fieldobs.sources.tables import LANDING
from fieldobs.streaming import live
from tests.conftest import at


def land(spark, folder, *rows):
    spark.createDataFrame(rows, LANDING).coalesce(1).write.mode("append").json(folder)


def device(station, seq, epoch, **values):
    return (station, "weathercloud", seq, json.dumps({"epoch": epoch, **values}))


def test_ingest_in_several_batches(spark, tmp_path):
    folder, store = str(tmp_path / "landing"), ReadingStore(spark, str(tmp_path / "store"))

    def run():
        live.ingest_to_store(live.landed_payloads(spark, folder), store, str(tmp_path / "cp"),
                             str(tmp_path / "bad")).awaitTermination()

    pws = json.dumps({"observations": [{"obsTimeUtc": "2024-01-01T00:00:00Z", "metric": {"temp": 4.0}}]})
    land(spark, folder, device("d", 1, 1704067200, temp=1.0), ("p", "wunderground", 2, pws), ("d", "weathercloud", 3, "junk"))
    run()
    land(spark, folder, device("d", 4, 1704067200, hum=50), device("d", 5, 1703980800, temp=9.0))
    run()
    run()
    got = {(r.station_id, r.observed_at): (r.temp_c, r.humidity) for r in store.read().collect()}
    assert got == {("d", at("2024-01-01 00:00")): (None, 50), ("p", at("2024-01-01 00:00")): (4.0, None),
                   ("d", at("2023-12-31 00:00")): (9.0, None)}
    assert spark.read.schema(LANDING).parquet(str(tmp_path / "bad")).count() == 1


def stream(spark, rows, folder, parts):
    """The rows as a stream of files, ``parts`` of them, one per micro-batch."""
    for i, (lo, hi) in enumerate(parts):
        ts = F.col("observed_at")
        rows.where((ts >= F.lit(lo).cast("timestamp_ntz")) & (ts < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


PARTS = [("2024-01-01 00:00:00", "2024-01-01 06:07:00"), ("2024-01-01 06:07:00", "2024-01-02 00:00:00")]


def readings(make):
    return make.readings(*[{"station_id": s, "observed_at": f"2024-01-01 {h:02d}:{m:02d}", "temp_c": float(h - m), "wind_dir": h * 9,
                            "solar_radiation": 10.0 * h} for s in ("a", "b") for h in range(0, 24, 2) for m in (1, 6, 8)])


def test_partials_equal_batch(spark, make, tmp_path):
    rows, stations = readings(make), make.stations({"station_id": "a", "timezone": "Asia/Kolkata"}, {"station_id": "b"})
    folder = work_dir(spark, "test-partials")
    source = stream(spark, rows, f"{folder}/in", PARTS)
    query = live.live_partials(source, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 2
    got = live.partials_so_far(spark, f"{folder}/out")
    want = quarter_hour_partials(rows)
    order = ["station_id", "bucket_start"]
    naive = got.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))
    assert naive.count() == want.count()
    assert rollup_from_partials(naive, stations).orderBy("station_id", "day").collect() == \
        daily_rollup(rows, stations).orderBy("station_id", "day").collect()
    assert naive.select(*order, "temp_c__n", "sunny_n").orderBy(order).collect() == \
        want.select(*order, "temp_c__n", "sunny_n").orderBy(order).collect()


def test_redelivered_rows_count_once(spark, make, tmp_path):
    rows = readings(make)
    folder = work_dir(spark, "test-dedup")
    source = stream(spark, rows.unionByName(rows), f"{folder}/in", PARTS)
    live.append_to(live.redelivery_free(source), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == rows.count()


def test_latest_and_feed(spark, make):
    rows = readings(make)
    folder = work_dir(spark, "test-latest")
    source = stream(spark, rows, f"{folder}/in", list(reversed(PARTS)))
    live.latest_live(source, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = {r.station_id: r.observed_at for r in live.newest_latest(spark, f"{folder}/out").collect()}
    assert got == {s: at("2024-01-01 22:08") for s in ("a", "b")}
    live.append_to(live.station_feed(source, ["b"]), f"{folder}/feed", f"{folder}/cp2").awaitTermination()
    assert {r.station_id for r in spark.read.parquet(f"{folder}/feed").collect()} == {"b"}


def test_work_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(base + "/x-")


def test_every_line_is_stored_or_quarantined(spark, tmp_path):
    folder, store = tmp_path / "landing", ReadingStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    good = {"station_id": "d", "source": "weathercloud", "ingest_seq": 1, "payload": '{"epoch":1704067200,"temp":1.0}'}
    lines = [json.dumps(good), json.dumps({k: v for k, v in good.items() if k != "source"}), "no json at all"]
    (folder / "a.json").write_text("\n".join(lines))
    live.ingest_to_store(live.landed_payloads(spark, str(folder)), store, str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()
    assert store.read().count() == 1
    assert {r.payload for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {good["payload"], "no json at all"}


def test_corrected_row_of_a_later_batch_wins(spark, make):
    """Over restarts from the checkpoint: the state goes on, older rows change nothing."""
    folder = work_dir(spark, "test-corrected")
    for instant, temp in [("10:00", 1.0), ("10:00", 2.0), ("09:00", 9.0), ("10:00", 3.0), ("08:00", 0.0)]:
        rows = make.readings({"observed_at": f"2024-01-01 {instant}", "temp_c": temp})
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        live.latest_live(source, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert [r.temp_c for r in live.newest_latest(spark, f"{folder}/out").collect()] == [3.0]
    live.latest_live(source, f"{folder}/out", f"{folder}/cp").awaitTermination()  # nothing new
    assert [r.temp_c for r in live.newest_latest(spark, f"{folder}/out").collect()] == [3.0]


def test_a_replayed_trigger_changes_nothing(spark, make):
    rows = make.readings({"station_id": "a", "observed_at": "2024-01-01 10:00", "temp_c": 1.0},
                         {"station_id": "b", "observed_at": "2024-01-01 11:00", "temp_c": 2.0})
    store = LatestStore(spark, work_dir(spark, "test-replay") + "/t", rows.schema)
    later = make.readings({"station_id": "a", "observed_at": "2024-01-01 12:00", "temp_c": 3.0})
    for batch in (rows, later, later, rows):
        store.merge(batch)
    assert {r.station_id: r.temp_c for r in store.latest().collect()} == {"a": 3.0, "b": 2.0}


def test_last_write_within_a_batch_wins(spark, make):
    folder = work_dir(spark, "test-sequence")
    rows = make.readings({"observed_at": "2024-01-01 10:00", "temp_c": 1.0}, {"observed_at": "2024-01-01 10:00", "temp_c": 2.0})
    rows = rows.withColumn("seq", F.when(F.col("temp_c") == 1.0, 2).otherwise(1))
    rows.coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    live.latest_live(source, f"{folder}/out", f"{folder}/cp", sequence="seq").awaitTermination()
    assert [r.temp_c for r in live.newest_latest(spark, f"{folder}/out").collect()] == [1.0]


def test_rows_behind_the_watermark_wait_for_the_batch_rollup(spark, make):
    """The aggregate branch drops them; the rollup of the raw rows has them."""
    rows, stations = readings(make), make.stations({"station_id": "a"}, {"station_id": "b"})
    late = make.readings({"station_id": "a", "observed_at": "2024-01-01 01:00", "temp_c": 50.0})
    folder = work_dir(spark, "test-late")
    source = stream(spark, rows, f"{folder}/in", PARTS)
    run = lambda: live.live_partials(source, f"{folder}/out", f"{folder}/cp").awaitTermination()
    run()
    late.write.mode("append").parquet(f"{folder}/in")
    run()
    got = live.partials_so_far(spark, f"{folder}/out")
    peak = got.agg(F.max("temp_c__max")).first()[0]
    assert peak == 21.0 and daily_rollup(rows.unionByName(late), stations).agg(F.max("temp_max")).first()[0] == 50.0

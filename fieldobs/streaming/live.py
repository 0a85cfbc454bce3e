"""Structured Streaming over landed payloads and readings.

Two branches. The raw store is fed by ``ingest_to_store``: last write wins and late rows
are kept. ``redelivery_free`` and ``tumbling_15m`` feed provisional aggregates: the first
copy of a key counts and rows behind the watermark are dropped; the batch rollup, which
recomputes whole days from the raw store, replaces them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from fieldobs.operators import ingest, scan
from fieldobs.operators.daily import PARTIAL_MINUTES, partial_aggregates
from fieldobs.operators.latest import stale_stations
from fieldobs.session import use_utc
from fieldobs.sources.store import KeyedStore, LatestStore, PartialStore, ReadingStore
from fieldobs.sources.tables import LANDING

WATERMARK = "2 hours"


def _run(writer: DataStreamWriter, checkpoint: str, every: str | None, name: str | None = None) -> StreamingQuery:
    """Start a writer: continuously, a micro-batch ``every`` so often, or once over what is there."""
    writer = writer.queryName(name) if name else writer
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def admitted(reader: DataStreamReader, max_files: int | None = None, max_bytes: int | None = None) -> DataStreamReader:
    """Limit what one micro-batch of a file source takes, by files or by bytes.

    A backlog, as after an outage, is then worked off in batches of a size the cluster is made for, oldest files first.
    """
    if max_files and max_bytes:
        raise ValueError("limit files or bytes, not both")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader


def landed_payloads(spark: SparkSession, folder: str, max_files: int | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """Payload files as they land; every micro-batch takes the files new since the last, up to the limit given.

    A line that is no JSON comes as a payload without a source, which goes to quarantine.
    """
    whole = T.StructType([*LANDING.fields, T.StructField("_line", T.StringType())])
    reader = admitted(use_utc(spark).readStream.schema(whole), max_files, max_bytes)
    rows = reader.option("columnNameOfCorruptRecord", "_line").json(folder)
    return rows.withColumn("payload", F.coalesce("payload", "_line")).drop("_line")


def ingest_to_store(payloads: DataFrame, store: ReadingStore, checkpoint: str,
                    quarantine: str | None = None, every: str | None = None) -> StreamingQuery:
    """Parse, conform and upsert every micro-batch. A replayed batch changes nothing.

    Every landed row is stored or quarantined.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        intake = ingest.Intake(batch)
        store.merge(intake.accepted("ingest_seq"), "ingest_seq")
        if quarantine:
            intake.rejected().write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        intake.close()

    return _run(payloads.writeStream.foreachBatch(write), checkpoint, every)


def with_event_time(readings: DataFrame) -> DataFrame:
    """Watermarks need an instant type."""
    return readings.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def station_feed(readings: DataFrame, station_ids: Iterable | None = None) -> DataFrame:
    """The live rows of one or several stations, or of all."""
    return scan.of_stations(readings, station_ids)


def redelivery_free(readings: DataFrame) -> DataFrame:
    return (with_event_time(readings).withWatermark("observed_at", WATERMARK)
            .dropDuplicatesWithinWatermark(["station_id", "observed_at"]))


def tumbling_15m(readings: DataFrame) -> DataFrame:
    """Mergeable partials per station and quarter hour of UTC time."""
    bucket = F.window("observed_at", f"{PARTIAL_MINUTES} minutes")
    return (with_event_time(readings).withWatermark("observed_at", WATERMARK)
            .groupBy("station_id", bucket).agg(*partial_aggregates())
            .withColumn("bucket_start", F.col("window.start")).drop("window"))


def append_to(stream: DataFrame, table: str, checkpoint: str, every: str | None = None,
              name: str | None = None) -> StreamingQuery:
    """Append the stream's rows to a parquet table, each once. ``name`` is what ``accounts`` knows the stream by."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", table)
    return _run(writer, checkpoint, every, name)


def _keyed(stream: DataFrame, store: KeyedStore, checkpoint: str, every: str | None) -> StreamingQuery:
    """Put the groups that each micro-batch changed over the stored ones; replays change nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch)

    return _run(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, every)


def live_partials(readings: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a table of quarter-hour partials current, open windows included.

    The sums are streaming state; each trigger rewrites the dates of the windows it changed.
    """
    partials = tumbling_15m(readings)
    return _keyed(partials, PartialStore(readings.sparkSession, table, partials.schema), checkpoint, every)


def partials_so_far(spark: SparkSession, table: str) -> DataFrame:
    return use_utc(spark).read.parquet(table).drop(PartialStore.partition)


def newest_rows(readings: DataFrame, sequence: str | None = None) -> DataFrame:
    """The newest row of every station as streaming state: one row a station, whatever was streamed.

    Of several rows at the same instant the one of the latest micro-batch counts, and within a
    batch the one with the highest ``sequence``.
    """
    rest = [c for c in readings.columns if c not in ("station_id", "observed_at", sequence)]
    # The time of the micro-batch: the same for all its rows, and again when it is replayed.
    dated = readings.withColumn("_batch", F.current_timestamp())
    order = F.struct("observed_at", "_batch", *([sequence] if sequence else []))
    row = F.struct("observed_at", *rest)
    return dated.groupBy("station_id").agg(F.max_by(row, order).alias("_row")).select("station_id", "_row.*")


def latest_live(readings: DataFrame, table: str, checkpoint: str, every: str | None = None,
                sequence: str | None = None) -> StreamingQuery:
    """Keep a table of every station's newest row current; ``newest_latest`` reads it."""
    newest = newest_rows(readings, sequence)
    return _keyed(newest, LatestStore(readings.sparkSession, table, newest.schema), checkpoint, every)


def newest_latest(spark: SparkSession, table: str) -> DataFrame:
    return use_utc(spark).read.parquet(table).drop(LatestStore.partition)


def stale_now(stations: DataFrame, table: str, as_of: dt.datetime) -> DataFrame:
    """The stations that are silent by the live table of newest rows."""
    return stale_stations(stations, newest_latest(stations.sparkSession, table), as_of)

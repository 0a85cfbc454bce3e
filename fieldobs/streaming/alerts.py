"""An alert that fires by itself: stations that fall silent, and that return.

One keyed state per station holds its last instant and a timer. A timer runs out without any
new input, so a silent station is told of at the first trigger after its limit; a reading
moves the timer. The only operator of the library that runs Python, since Spark offers timers
through ``transformWithState`` alone: one call per station and micro-batch, not per reading of others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldobs.functions import clock
from fieldobs.operators.latest import stale_minutes
from fieldobs.session import use_timers
from fieldobs.streaming.live import WATERMARK, with_event_time

SILENT, RETURNED = "silent", "returned"


class SilenceWatch(StatefulProcessor):
    """Tells once that a station fell silent and once that it is back, in the order of its readings.

    The clock is the watermark or the time of the trigger. A station counts as seen when it was
    added. Readings no newer than the last one change nothing.
    """

    STATE = "last long, wait long, silent boolean, reported boolean"
    ALERT = "station_id {}, kind string, at long, seen long"

    def __init__(self, by_event_time: bool):
        self.by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("station", self.STATE)

    def _now(self, timers) -> int:
        ms = timers.getCurrentWatermarkInMs() if self.by_event_time else timers.getCurrentProcessingTimeInMs()
        return max(ms, 0) * 1000

    def _arm(self, due: int) -> None:
        """One timer a station: at the first millisecond by which it is silent."""
        for other in self.handle.listTimers():
            self.handle.deleteTimer(other)
        self.handle.registerTimer(-(-due // 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        added = initialState["added"]
        last = self._now(timerValues) if added is None else added
        self.state.update((last, initialState["wait"], False, False))
        self._arm(last + initialState["wait"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = sorted({(r["instant"], r["wait"]) for r in rows})
        last, wait, silent, reported = self.state.get() if self.state.exists() else (None, None, False, False)
        for instant, wait in arrived:
            if last is not None and instant <= last:
                continue
            if last is not None and instant - last > wait:
                if not silent:
                    yield self._alert(key, SILENT, last + wait, last if reported else None)
                yield self._alert(key, RETURNED, instant, last if reported else None)
                silent = False
            last, reported = instant, True
        if last is None:
            return
        if last + wait > self._now(timerValues):
            if silent:  # a reading that came late, yet soon enough
                yield self._alert(key, RETURNED, last, last)
            silent = False
            self._arm(last + wait)
        elif not silent:
            yield self._alert(key, SILENT, last + wait, last if reported else None)
            silent = True
        self.state.update((last, wait, silent, reported))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        last, wait, silent, reported = self.state.get()
        if not silent and -(-(last + wait) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, wait, True, reported))
            yield self._alert(key, SILENT, last + wait, last if reported else None)

    @staticmethod
    def _alert(key, kind: str, at: int, seen: int | None) -> Row:
        return Row(station_id=key[0], kind=kind, at=at, seen=seen)

    def close(self) -> None:
        pass


def silence_alerts(readings: DataFrame, stations: DataFrame, by_event_time: bool = False,
                   delay: str = WATERMARK) -> DataFrame:
    """A stream of alerts: station_id, kind (silent or returned), at, observed_at (the last reading before; null if none), issue.

    By default the clock is that of the triggers: a station is told of when its limit has passed,
    also if nothing at all arrives. ``by_event_time`` takes the watermark (newest instant less
    ``delay``) instead, so that a replay of the same files gives the same alerts. Stations of the
    dimension that never report are told of once. Unknown stations are ignored. The session's
    streams keep their state in RocksDB from then on.
    """
    use_timers(readings.sparkSession)
    micros = clock.micros(F.col("observed_at"))
    wait = stale_minutes(F.col("source")).cast("long") * 60_000_000
    known = stations.select("station_id", wait.alias("wait"), clock.micros(F.col("created_at")).alias("added"))
    timed = with_event_time(readings.select("station_id", "observed_at"))
    if by_event_time:
        timed = timed.withWatermark("observed_at", delay)
    rows = timed.join(known.select("station_id", "wait"), "station_id").withColumn("instant", micros)
    key = readings.schema["station_id"].dataType.simpleString()
    alerts = rows.groupBy("station_id").transformWithState(
        SilenceWatch(by_event_time), SilenceWatch.ALERT.format(key), "Append",
        "EventTime" if by_event_time else "ProcessingTime", known.groupBy("station_id"))
    told = stations.select("station_id", F.format_string(
        "%s (%s): no data in last %d minutes", F.col("name"), F.col("wunderground_id"), stale_minutes(F.col("source"))).alias("issue"))
    return alerts.join(told, "station_id").select(
        "station_id", "kind", *[F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("at", "at"), ("seen", "observed_at"))],
        F.when(F.col("kind") == SILENT, F.col("issue")).alias("issue"))


def current_alerts(alerts: DataFrame) -> DataFrame:
    """The stations that are silent now, from a table of all alerts: those whose last one says so."""
    last = alerts.groupBy("station_id").agg(F.max_by(F.struct("kind", "at", "observed_at", "issue"), F.struct(
        "at", (F.col("kind") == SILENT))).alias("last"))
    return last.select("station_id", "last.*").where(F.col("kind") == SILENT).drop("kind")

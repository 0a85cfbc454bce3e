"""Answers to the questions a dashboard asks, each as lazily evaluated DataFrames."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.operators import buckets, compare, daily as daily_ops, latest, maintenance, network, scan, summary
from fieldobs.plans import timewin
from fieldobs.schema import DAILY_METRICS
from fieldobs.session import use_utc
from fieldobs.sources.store import DailyStore, ReadingStore

# Daily column that stands for a measurement in charts of daily rows.
DAILY_OF = {"temp_c": "temp_avg"}


@dataclass(frozen=True)
class Answer:
    """``mode`` says which row type ``data`` holds: raw readings or daily rows."""

    mode: str
    data: DataFrame
    latest: DataFrame


@dataclass(frozen=True)
class Network:
    """Stations, raw readings and the daily rollup, asked as of an instant.

    Stores also tell each station's newest row (``last_seen``), the (station_id, obs_date) merged
    since the rollup ran (``touched``), and since when the raw rows are whole (``horizon``). From
    plain tables latest rows take more reading, and long ranges end with the rollup, unless
    ``live_tail`` asks for the days after each station's last rolled one.
    """

    stations: DataFrame
    readings: DataFrame
    daily: DataFrame
    last_seen: DataFrame | None = None
    touched: DataFrame | None = None
    horizon: dt.datetime | None = None
    live_tail: bool = False

    def __post_init__(self) -> None:
        use_utc(self.stations.sparkSession)

    @classmethod
    def of_stores(cls, stations: DataFrame, raw: ReadingStore, rollup: DailyStore) -> Network:
        raw.recover()
        rollup.recover()
        touched = raw.touched()
        if touched is None:
            touched = raw.read([]).select("station_id", "obs_date")
        return cls(stations, raw.read(), rollup.read(), raw.latest(), touched, raw.horizon())

    def days(self, as_of: dt.datetime, station_ids: list | None = None) -> DataFrame:
        """The rollup with its live tail, as the nightly job would leave it now: days that it has not taken in yet
        come from the raw rows."""
        stored, stations = scan.of_stations(self.daily, station_ids), scan.of_stations(self.stations, station_ids)
        if self.touched is None and not self.live_tail:
            return stored
        raw = scan.of_stations(self.readings, station_ids)
        touched = (maintenance.behind(stored, raw, stations) if self.touched is None
                   else scan.of_stations(self.touched, station_ids))
        return maintenance.live_rollup(stored, raw, stations, touched, self.horizon or maintenance.prune_cutoff(as_of))

    def station_list(self) -> DataFrame:
        return scan.station_list(self.stations)

    def station_readings(self, station_id, as_of: dt.datetime, range_name: str = "today",
                         window: tuple | None = None, limit: int | None = None) -> Answer:
        """Rows of one station. Today and 7d (or a custom window) come raw, 30d is aggregated
        from raw rows, longer ranges read the rollup and, for the days it lacks, the raw rows. There
        is no cap unless one is asked for."""
        one = scan.of_stations(self.readings, [station_id])
        known = scan.of_stations(self.stations, [station_id])
        seen = None if self.last_seen is None else scan.of_stations(self.last_seen, [station_id])
        newest = latest.latest_rows(known, one, as_of, daily=scan.of_stations(self.daily, [station_id]), last_seen=seen)
        if window:
            rows = scan.readings_between(one, *window).orderBy("observed_at")
            return Answer("raw", rows.limit(limit) if limit else rows, newest)
        name = timewin.checked_range(range_name)
        start = timewin.range_start(name, as_of)
        if name in ("1y", "all"):
            rows = scan.daily_between(self.days(as_of, [station_id]), start.date()).orderBy("day")
            return Answer("daily", rows.limit(limit) if limit else rows, newest)
        if name == "30d":
            live = scan.readings_since(one, start, as_of)
            return Answer("daily", daily_ops.daily_rollup(live, self.stations).orderBy("day"), newest)
        rows = (scan.today_so_far(one, self.stations, as_of).select(*one.columns) if name == "today"
                else scan.readings_since(one, start, as_of))
        if limit:
            rows = rows.orderBy(F.desc("observed_at")).limit(limit)
        return Answer("raw", rows.orderBy("observed_at"), newest)

    def overview(self, as_of: dt.datetime) -> DataFrame:
        return latest.station_cards(self.stations, self.readings, as_of, self.daily, self.last_seen)

    def regions(self, as_of: dt.datetime) -> DataFrame:
        return network.region_stats(self.overview(as_of))

    def highlights(self, as_of: dt.datetime) -> DataFrame:
        return network.network_highlights(self.overview(as_of))

    def health(self, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
        return (latest.network_health(self.stations, self.readings, as_of),
                latest.stale_stations(self.stations, self.readings, as_of))

    def data_range(self, station_id=None) -> DataFrame:
        ids = None if station_id is None else [station_id]
        return scan.data_range(scan.of_stations(self.readings, ids), scan.of_stations(self.daily, ids))

    def chart_series(self, station_id, as_of: dt.datetime, range_name: str = "today",
                     metrics: tuple[str, ...] = ("temp_c",)) -> Answer:
        """Points of a chart: raw readings for a day, six-hour means for a week, daily rows beyond."""
        name = timewin.checked_range(range_name)
        answer = self.station_readings(station_id, as_of, name)
        if name != "7d":
            columns = [m for m in (DAILY_OF.get(m, m) if answer.mode == "daily" else m for m in metrics)]
            at = "day" if answer.mode == "daily" else "observed_at"
            return Answer(answer.mode, answer.data.select("station_id", at, *columns), answer.latest)
        rows = buckets.bucket_6h(answer.data, scan.of_stations(self.stations, [station_id]), metrics)
        return Answer("6h", rows, answer.latest)

    def compare_periods(self, a: timewin.Period, b: timewin.Period, station_id=None) -> dict[str, DataFrame]:
        ids = None if station_id is None else [station_id]
        rows = scan.of_stations(self.daily, ids)
        return {
            "aligned": compare.compare_periods_aligned(rows, a, b),
            "stats": compare.compare_period_stats(rows, a, b),
            "text": compare.summary_comparison_text(compare.compare_summary_stats(rows, a, b), a.label, b.label),
        }

    def compare_days(self, a: dt.date, b: dt.date, station_id=None) -> dict[str, DataFrame]:
        ids = None if station_id is None else [station_id]
        rows = scan.of_stations(self.readings, ids)
        return {"aligned": compare.compare_days_hourly(rows, self.stations, a, b),
                "stats": compare.compare_day_stats(rows, self.stations, a, b)}

    def compare_stations(self, requested: DataFrame, as_of: dt.datetime, range_name: str = "30d") -> DataFrame:
        """Daily series of the requested stations: short ranges from raw, long ones from the rollup
        and its live tail."""
        name = timewin.comparison_range(range_name)
        start = timewin.comparison_range_start(name, as_of)
        # A request names a few stations: their ids go into the plan and reach the row groups.
        ids = [r["station_id"] for r in requested.select("station_id").distinct().limit(scan.MAX_COMPARED + 1).collect()]
        if len(ids) > scan.MAX_COMPARED:
            raise ValueError(f"more than {scan.MAX_COMPARED} stations")
        if name in ("7d", "30d"):
            rows = scan.readings_since(self.readings, start, as_of, ids)
            series = daily_ops.daily_rollup(rows, self.stations)
        else:
            series = scan.daily_between(self.days(as_of, ids), start.date())
        return compare.compare_stations(requested, self.stations, series, DAILY_METRICS)

    def summarise_days(self, start: dt.date, end: dt.date, label: str) -> DataFrame:
        rows = scan.daily_between(self.daily, start, end)
        return summary.summary_daily_text(summary.summary_daily_stats(rows), label)

    def summarise_window(self, start: dt.datetime, end: dt.datetime, label: str) -> DataFrame:
        rows = scan.readings_between(self.readings, start, end)
        return summary.summary_period_text(summary.summary_period_stats(rows, self.stations), label)

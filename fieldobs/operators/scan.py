"""Scans, filters and limits over stations, readings and the daily rollup."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldobs.functions import clock
from fieldobs.plans.timewin import RETENTION_DAYS, checked_window

# Fixed value: the shape of a station id.
UUID_FORM = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_COMPARED = 4


def station_list(stations: DataFrame) -> DataFrame:
    """Primary station first, then oldest first."""
    return stations.orderBy(F.desc("is_primary"), F.asc("created_at"), F.asc("station_id"))


def of_stations(df: DataFrame, station_ids: Iterable | None) -> DataFrame:
    return df if station_ids is None else df.where(F.col("station_id").isin(list(station_ids)))


def readings_between(readings: DataFrame, start, end, station_ids: Iterable | None = None) -> DataFrame:
    """Half-open window on the stored instant, pushed down to the scan."""
    lo, hi = checked_window(start, end)
    ts = F.col("observed_at")
    rows = readings.where((ts >= clock.instant(lo)) & (ts < clock.instant(hi)))
    if "obs_date" in readings.columns:
        rows = rows.where(F.col("obs_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return of_stations(rows, station_ids)


def readings_since(readings: DataFrame, start: dt.datetime, as_of: dt.datetime,
                   station_ids: Iterable | None = None) -> DataFrame:
    """Rows from ``start`` up to and including ``as_of``."""
    ts = F.col("observed_at")
    rows = readings.where((ts >= clock.instant(start)) & (ts <= clock.instant(as_of)))
    if "obs_date" in readings.columns:
        rows = rows.where(F.col("obs_date").between(F.lit(start.date()), F.lit(as_of.date())))
    return of_stations(rows, station_ids)


def zones_in_use(stations: DataFrame, limit: int = 64) -> DataFrame:
    """The dimension with its zones declared, read from it by one small job.

    More zones than ``limit`` are not declared: every row then looks its zone up.
    """
    rows = stations.where(F.col("timezone").isNotNull()).select("timezone").distinct().limit(limit + 1).collect()
    names = sorted(r["timezone"] for r in rows)
    return clock.declare_zones(stations, names) if len(names) <= limit else stations


def with_zone(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach each station's zone; readings of unknown stations are dropped.

    No broadcast is forced. Catalyst broadcasts the two-column dimension while its
    size is under the session's threshold; beyond it the join shuffles, and adaptive
    execution splits the partitions of a station that holds much of the data.
    """
    return readings.join(stations.select("station_id", "timezone"), "station_id")


def with_local_time(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Add ``local_ts`` and ``local_day`` on the station's own clock."""
    local = clock.to_local(F.col("observed_at"), F.col("timezone"), clock.declared_zones(stations))
    return (with_zone(readings, stations)
            .withColumn("local_ts", local)
            .withColumn("local_day", F.col("local_ts").cast("date")))


def in_local_days(readings: DataFrame, stations: DataFrame, first: dt.date, end: dt.date) -> DataFrame:
    """Rows whose local day lies in [first, end).

    The zone-converted column cannot be pushed down, so a bound on the stored instant
    widened by the largest zone offsets goes along.
    """
    def midnight(day: dt.date, days: int) -> dt.datetime:
        return dt.datetime.combine(day, dt.time()) + dt.timedelta(days=days)

    near = readings_between(readings, midnight(first, -1), midnight(end, 1))
    day = F.col("local_day")
    return with_local_time(near, stations).where((day >= F.lit(first)) & (day < F.lit(end)))


def since_midnight_bound(readings: DataFrame, stations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows since the earliest local midnight, and of the last hour at least, with the start of
    their station's current day (``day_start``).

    Days can be longer than 24 hours, so one small job asks the dimension how far back the
    current ones reach; that bound then goes to the scan as a literal.
    """
    starts = stations.select("station_id", clock.local_midnight(
        clock.instant(as_of), F.col("timezone")).alias("day_start"))
    earliest = starts.agg(F.min("day_start")).first()[0]
    since = min(earliest or as_of, as_of - dt.timedelta(hours=1))
    return readings_since(readings, since, as_of).join(starts, "station_id")


def today_so_far(readings: DataFrame, stations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows since the station's own midnight."""
    rows = since_midnight_bound(readings, stations, as_of)
    return rows.where(F.col("observed_at") >= F.col("day_start"))


def daily_between(daily: DataFrame, first, end=None, station_ids: Iterable | None = None) -> DataFrame:
    day = F.col("day")
    rows = daily.where(day >= F.lit(first).cast("date"))
    if end is not None:
        rows = rows.where(day < F.lit(end).cast("date"))
    return of_stations(rows, station_ids)


def earliest_n(df: DataFrame, n: int, order: str = "observed_at") -> DataFrame:
    return df.orderBy(F.asc(order), F.asc("station_id")).limit(n)


def recent_n(readings: DataFrame, n: int) -> DataFrame:
    """The most recent ``n`` rows of every station.

    Ranked first within each UTC date, then within the station, so no task sorts more
    of a busy station than one date, or ``n`` rows per date.
    """
    newest = F.desc("observed_at")
    by_date = Window.partitionBy("station_id", F.col("observed_at").cast("date")).orderBy(newest)
    overall = Window.partitionBy("station_id").orderBy(newest)
    return (readings.withColumn("_r", F.row_number().over(by_date)).where(F.col("_r") <= n)
            .withColumn("_r", F.row_number().over(overall)).where(F.col("_r") <= n).drop("_r"))


def recent_n_ascending(readings: DataFrame, n: int) -> DataFrame:
    return recent_n(readings, n).orderBy("station_id", "observed_at")


def data_range(readings: DataFrame, daily: DataFrame) -> DataFrame:
    """First and last reading per station, and the first day of its rollup.

    Stations with rows in one of the two only are there, too.
    """
    raw = readings.groupBy("station_id").agg(
        F.min("observed_at").alias("min_at"), F.max("observed_at").alias("max_at"))
    rolled = daily.groupBy("station_id").agg(F.min("day").alias("daily_min"))
    return raw.join(rolled, "station_id", "full")


def period_bounds(ranges: DataFrame, stations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Days, on the station's own clock, that a period may be picked from: raw-backed days
    reach back to the retention floor, longer periods to the first rollup day."""
    zone = F.col("timezone")

    def local(ts: Column) -> Column:
        return clock.to_local(ts, zone).cast("date")

    floor = F.date_sub(local(clock.instant(as_of)), RETENTION_DAYS)
    raw_min = local(F.col("min_at"))
    return ranges.join(stations.select("station_id", "timezone"), "station_id").select(
        "station_id",
        F.when(raw_min.isNotNull(), F.greatest(raw_min, floor)).alias("day_floor"),
        F.coalesce(F.col("daily_min"), raw_min).alias("period_floor"),
        local(F.col("max_at")).alias("ceiling"),
    )


def sensor_availability(readings: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Per station, whether the window reports each metric at all."""
    return readings.groupBy("station_id").agg(
        *[(F.count(m) > 0).alias(f"has_{m}") for m in metrics])


def parse_station_ids(text: str) -> list[str]:
    """Request argument form: 1 to 4 distinct ids, in order of first mention."""
    ids = list(dict.fromkeys(part.strip() for part in text.split(",") if part.strip()))
    if not 1 <= len(ids) <= MAX_COMPARED or not all(re.match(UUID_FORM, i) for i in ids):
        raise ValueError("give 1 to 4 station ids")
    return ids


def station_ids(text: Column) -> Column:
    """Column form: trimmed, distinct, non-empty parts of a comma-separated list."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part))
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def station_ids_valid(ids: Column) -> Column:
    return F.size(ids).between(1, MAX_COMPARED) & F.forall(ids, lambda i: i.rlike(UUID_FORM))

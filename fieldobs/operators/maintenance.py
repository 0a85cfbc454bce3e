"""Writes as DataFrames: upserts, rollup refresh, retention, deletes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import clock
from fieldobs.operators.daily import daily_rollup
from fieldobs.operators.latest import first_by
from fieldobs.plans.timewin import RETENTION_DAYS
from fieldobs.schema import DAILY_COLUMNS, DAILY_KEY, DAILY_METRICS, READING_KEY


def last_write(batch: DataFrame, sequence: str) -> DataFrame:
    """One row per key: the one written last.

    Each map task keeps one row per key before the shuffle, so a key redelivered any
    number of times costs one row per task.
    """
    return first_by(batch, list(READING_KEY), F.desc(sequence)).drop(sequence)


def upsert(stored: DataFrame, batch: DataFrame, coalesce_existing: bool = False) -> DataFrame:
    """Stored rows with the (key-unique) batch applied: a row is replaced whole, nulls included.

    ``coalesce_existing`` keeps a stored value where the new row has none. Batch keys below the
    session's broadcast size are broadcast when the query runs, and the stored rows not shuffled.
    """
    key = list(READING_KEY)
    columns = stored.columns
    if not coalesce_existing:
        return stored.join(batch.select(*key), key, "left_anti").unionByName(batch.select(*columns))
    merged = stored.alias("s").join(batch.alias("b"), key, "full")
    rest = [c for c in columns if c not in key]
    return merged.select(*key, *[F.coalesce(f"b.{c}", f"s.{c}").alias(c) for c in rest]).select(*columns)


def coalesced(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with the stored values of the same key where they have none themselves."""
    key = list(READING_KEY)
    both = batch.alias("b").join(stored.alias("s"), key, "left")
    return both.select(*[c if c in key else F.coalesce(f"b.{c}", f"s.{c}").alias(c) for c in batch.columns])


def prune_cutoff(as_of: dt.datetime, retention_days: int = RETENTION_DAYS) -> dt.datetime:
    """Start of the UTC day of the limit: raw rows go by whole days only."""
    limit = as_of - dt.timedelta(days=retention_days)
    return limit.replace(hour=0, minute=0, second=0, microsecond=0)


def _kept(cutoff: dt.datetime) -> Column:
    return F.col("observed_at") >= clock.instant(cutoff)


def retained(readings: DataFrame, as_of: dt.datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    return readings.where(_kept(prune_cutoff(as_of, retention_days)))


def prune_report(readings: DataFrame, as_of: dt.datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Per station: rows kept and pruned."""
    kept = _kept(prune_cutoff(as_of, retention_days))
    return readings.groupBy("station_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("pruned"))


def rollup_refresh(stored: DataFrame, readings: DataFrame, stations: DataFrame,
                   horizon: dt.datetime, only: DataFrame | None = None) -> DataFrame:
    """The rollup after recomputing what the raw store still holds in full.

    ``horizon`` is the start of the raw store. A local day that began before it may have
    lost rows to pruning, so it is taken from raw only when the rollup lacks it; days
    without raw rows keep their stored row. ``only`` (station_id, day) limits what is recomputed.
    """
    key = list(DAILY_KEY)
    zones = stations.select("station_id", "timezone")
    began = clock.to_utc(F.col("day").cast("timestamp_ntz"), F.col("timezone"))
    fresh = (daily_rollup(readings, stations).join(zones, "station_id")
             .withColumn("whole", began >= clock.instant(horizon)).select(*DAILY_COLUMNS, "whole"))
    if only is not None:
        fresh = fresh.join(only, key, "left_semi")
    both = (stored.select(*DAILY_COLUMNS, F.lit(True).alias("had")).alias("s")
            .join(fresh.alias("f"), key, "full"))
    use_fresh = F.col("f.whole") | F.col("s.had").isNull()
    return both.select(*key, *[
        F.when(use_fresh, F.col(f"f.{m}")).otherwise(F.col(f"s.{m}")).alias(m) for m in DAILY_METRICS])


def days_touched(keys: DataFrame) -> DataFrame:
    """(station_id, day) of the local days that touched (station_id, obs_date) can reach.

    A UTC date overlaps the local days from the one before to the one after.
    """
    around = F.explode(F.sequence(F.date_sub("obs_date", 1), F.date_add("obs_date", 1)))
    return keys.select("station_id", around.alias("day")).distinct()


def dates_near(dates: Iterable[dt.date]) -> list[dt.date]:
    """The UTC dates whose rows make up the local days that touched dates can reach.

    A touched date reaches the local days around it, and these the dates around them.
    """
    return sorted({d + dt.timedelta(days=n) for d in dates for n in (-2, -1, 0, 1, 2)})


def behind(stored: DataFrame, readings: DataFrame, stations: DataFrame) -> DataFrame:
    """(station_id, obs_date) that the rollup may not have taken in, where no store tells: each station's dates from
    around its last rolled day on, and all dates of a station the rollup doesn't know.

    One small job asks the rollup how far back that reaches; the readings are read from there on,
    or all of them if it doesn't know some station.
    """
    last = stations.select("station_id").distinct().join(
        stored.groupBy("station_id").agg(F.max("day").alias("last")), "station_id", "left")
    told = last.agg(F.min("last").alias("first"), F.count_if(F.col("last").isNull()).alias("unknown")).first()
    dated = "obs_date" in readings.columns
    date = F.col("obs_date") if dated else F.col("observed_at").cast("date")
    if told["first"] is not None and not told["unknown"]:
        since = told["first"] - dt.timedelta(days=1)
        bound = date >= F.lit(since) if dated else F.col("observed_at") >= clock.instant(dt.datetime.combine(since, dt.time()))
        readings = readings.where(bound)
    pairs = readings.select("station_id", date.alias("obs_date")).distinct()
    return pairs.join(last, "station_id").where(
        F.col("last").isNull() | (F.col("obs_date") >= F.date_sub("last", 1))).select("station_id", "obs_date")


def live_rollup(stored: DataFrame, readings: DataFrame, stations: DataFrame, touched: DataFrame,
                horizon: dt.datetime | None = None) -> DataFrame:
    """The rollup as it would be now: days reached by ``touched`` (station_id, obs_date) come from the raw rows,
    all others as stored.

    One small job asks which dates are touched; only the dates around them are read. The raw
    rows are combined to days map-side before they meet the touched pairs. As in
    ``rollup_refresh``, a day that began before ``horizon`` is taken from raw only if the rollup lacks it.
    """
    key = list(DAILY_KEY)
    dates = [r["obs_date"] for r in touched.select("obs_date").distinct().collect()]
    if not dates:
        return stored.select(*DAILY_COLUMNS)
    pending = days_touched(touched)
    near = dates_near(dates)
    if "obs_date" in readings.columns:
        raw = readings.where(F.col("obs_date").isin(near))
    else:
        raw = readings.where((F.col("observed_at") >= clock.instant(dt.datetime.combine(near[0], dt.time())))
                             & (F.col("observed_at") < clock.instant(dt.datetime.combine(near[-1] + dt.timedelta(days=1), dt.time()))))
    redone = rollup_refresh(stored.join(pending, key, "left_semi"), raw, stations,
                            horizon or dt.datetime(1970, 1, 1), pending)
    return stored.join(pending, key, "left_anti").select(*DAILY_COLUMNS).unionByName(redone)


def add_missing_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Older files read with a newer column list: what they lack is null."""
    return rows.withColumns({n: F.lit(None).cast(k) for n, k in columns.items() if n not in rows.columns})


def removable(stations: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that may go: the primary station never does."""
    return (stations.where(~F.coalesce(F.col("is_primary"), F.lit(False)))
            .join(requested.select("station_id").distinct(), "station_id", "left_semi").select("station_id"))


def without_stations(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Delete cascade on any table keyed by station."""
    return table.join(removed, "station_id", "left_anti")

"""Partitioned parquet stores for raw readings, their latest rows, partials and the daily rollup.

A merge rewrites only the partitions it touches. The new content is first staged beside the
store and marked complete; then each staged partition takes the place of the old one by a rename,
and the staging goes. A job that dies leaves either an unmarked staging, which counts for
nothing, or a marked one, which the next job applies before it does anything else: no partition's
rows are lost at any point. One writer per store.

Rows of a file lie in the order of station and instant, with a Bloom filter on the station, so
a read of one station skips the row groups and pages of the others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldobs.operators import maintenance
from fieldobs.operators.latest import latest_per_station
from fieldobs.plans.timewin import RETENTION_DAYS
from fieldobs.schema import DAILY_COLUMNS, READING_COLUMNS, daily_schema, reading_schema
from fieldobs.session import use_utc

ONE_DAY = dt.timedelta(days=1)
# Small enough that a station's rows are a small part of the row groups of its file.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 4096


class PartitionedStore:
    partition = ""
    partition_type: T.DataType = T.DateType()
    # The order of rows inside a file.
    order: tuple[str, ...] = ("station_id",)

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, row_group_bytes: int = ROW_GROUP_BYTES):
        self.spark = use_utc(spark)
        self.path = path.rstrip("/")
        self.schema = T.StructType([f for f in schema.fields if f.name != self.partition]).add(
            self.partition, self.partition_type)
        self.layout = {"parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": PAGE_ROWS,
                       "parquet.bloom.filter.enabled#station_id": "true"}

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def _folders(self, path: str) -> list[str]:
        """Names of the partition folders under a path."""
        at, fs = self._at(path)
        if not fs.exists(at):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        return [n for n in names if n.startswith(f"{self.partition}=")]

    def exists(self) -> bool:
        return self._exists(self.path)

    def read(self, parts: list | None = None) -> DataFrame:
        """The store, or the given partitions; columns that older files lack read as null."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if parts is None else rows.where(F.col(self.partition).isin(parts))

    def partitions(self) -> list[dt.date]:
        """Partition days on disk: a listing, as long as the store is old. Other folders are skipped."""
        days = []
        for name in self._folders(self.path):
            try:
                days.append(dt.date.fromisoformat(name[len(self.partition) + 1:]))
            except ValueError:
                continue
        return sorted(days)

    @property
    def _staging(self) -> str:
        return f"{self.path}__staging"

    @property
    def _staged(self) -> str:
        """Marks a staging as complete. Readers of the folder skip names with an underscore."""
        return f"{self._staging}/_COMPLETE"

    def recover(self) -> None:
        """Apply a complete staging that an interrupted job left; drop an incomplete one."""
        if self._exists(self._staged):
            self._apply()
        elif self._exists(self._staging):
            self._delete(self._staging)

    def _apply(self) -> None:
        """Put every staged partition in the place of the old one. What is done stays done if it stops halfway."""
        at, fs = self._at(self.path)
        fs.mkdirs(at)
        for name in self._folders(self._staging):
            self._delete(f"{self.path}/{name}")
            fs.rename(self._at(f"{self._staging}/{name}")[0], self._at(f"{self.path}/{name}")[0])
        self._delete(self._staging)

    def _stage(self, rows: DataFrame) -> None:
        # Evens out the files: small days share a task, a busy day is split.
        even = rows.hint("rebalance", self.partition).sortWithinPartitions(self.partition, *self.order)
        even.write.mode("overwrite").options(**self.layout, partitionOverwriteMode="static").partitionBy(
            self.partition).parquet(self._staging)
        mark, fs = self._at(self._staged)
        fs.create(mark, True).close()

    def _overwrite_partitions(self, rows: DataFrame) -> None:
        self._stage(rows)
        self._apply()

    def drop_before(self, day: dt.date) -> list[dt.date]:
        gone = [d for d in self.partitions() if d < day]
        for d in gone:
            self._delete(f"{self.path}/{self.partition}={d}")
        return gone

    def remove_stations(self, removed: DataFrame) -> None:
        """Delete all rows of the given stations (station_id)."""
        ids = removed.select("station_id")
        self._remove(lambda rows: rows.join(ids, "station_id", "left_semi"),
                     lambda rows: maintenance.without_stations(rows, ids))

    def _remove(self, going, left) -> None:
        """Rewrite the partitions that hold rows to go; both arguments take rows and return the part meant."""
        self.recover()
        if not self.exists():
            return
        parts = sorted(r[0] for r in going(self.read()).select(self.partition).distinct().collect())
        if not parts:
            return
        rest = left(self.read(parts))
        emptied = set(parts) - {r[0] for r in rest.select(self.partition).distinct().collect()}
        if len(emptied) < len(parts):
            self._overwrite_partitions(rest.select(*self.schema.fieldNames()))
        for part in emptied:
            self._delete(f"{self.path}/{self.partition}={part}")


class KeyedStore(PartitionedStore):
    """Rows unique on a key, which settles their partition. A merge replaces rows by key, so one that is
    repeated changes nothing."""

    key: tuple[str, ...] = ()

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their partition."""
        raise NotImplementedError

    def _combined(self, stored: DataFrame, fresh: DataFrame) -> DataFrame:
        return stored.join(fresh.select(*self.key), list(self.key), "left_anti").unionByName(fresh)

    def merge(self, rows: DataFrame) -> None:
        """Put rows, one per key, over the stored ones."""
        self.recover()
        names = self.schema.fieldNames()
        # Used several times below; lost blocks are computed again.
        fresh = self._placed(rows).select(*names).persist()
        parts = sorted(r[0] for r in fresh.select(self.partition).distinct().collect())
        if parts:
            self._overwrite_partitions(self._combined(self.read(parts).select(*names), fresh).select(*names))
        fresh.unpersist()


class LatestStore(KeyedStore):
    """The newest row of every station, in buckets of stations."""

    partition, partition_type, key = "bucket", T.IntegerType(), ("station_id",)
    BUCKETS = 16

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.partition, F.pmod(F.xxhash64("station_id"), F.lit(self.BUCKETS)).cast("int"))

    def _combined(self, stored: DataFrame, fresh: DataFrame) -> DataFrame:
        """The newer row of each station; of the same instant the fresh one."""
        same = ["station_id", self.partition]
        both = stored.alias("s").join(fresh.alias("f"), same, "full")
        newer = F.col("f.observed_at") >= F.col("s.observed_at")
        use_fresh = F.coalesce(newer, F.col("s.observed_at").isNull())
        return both.select(*same, *[F.when(use_fresh, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
                                    for c in self.schema.fieldNames() if c not in same])

    def latest(self) -> DataFrame:
        return self.read().drop(self.partition)

    def forget_before(self, instant: dt.datetime) -> None:
        """Drop the stations whose newest row is older."""
        old = F.col("observed_at") < F.lit(str(instant)).cast("timestamp_ntz")
        self._remove(lambda rows: rows.where(old), lambda rows: rows.where(~old))


class PartialStore(KeyedStore):
    """Quarter-hour partials by UTC date, unique on station and start."""

    partition, key, order = "bucket_date", ("station_id", "bucket_start"), ("station_id", "bucket_start")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.partition, F.col("bucket_start").cast("date"))


class LateRows(KeyedStore):
    """Readings that came after their day was pruned, unique on station and instant."""

    partition, key, order = "obs_date", ("station_id", "observed_at"), ("station_id", "observed_at")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows


class TouchedDays(PartitionedStore):
    """(station_id, obs_date) merged since the last rollup; a pair may be noted more than once."""

    partition = "obs_date"

    def note(self, pairs: DataFrame) -> None:
        pairs.write.mode("append").partitionBy(self.partition).parquet(self.path)


class ReadingStore(PartitionedStore):
    """Raw readings by UTC date, unique on station and instant.

    Beside the store lie each station's newest row (``__latest``), the days that have been pruned
    (``__pruned``), rows that came too late for them (``__late``), and the (station, date) pairs
    merged since the last rollup (``__touched``).
    """

    partition, order = "obs_date", ("station_id", "observed_at")

    def __init__(self, spark: SparkSession, path: str, station_id: T.DataType | None = None,
                 row_group_bytes: int = ROW_GROUP_BYTES):
        schema = reading_schema(station_id or T.StringType())
        super().__init__(spark, path, schema, row_group_bytes)
        self._latest = LatestStore(spark, f"{self.path}__latest", schema)
        self._late = LateRows(spark, f"{self.path}__late", schema)
        self._touched = TouchedDays(spark, f"{self.path}__touched", T.StructType([schema["station_id"]]))

    def merge(self, batch: DataFrame, sequence: str, coalesce_existing: bool = False) -> None:
        """Upsert a batch; within it the row with the highest ``sequence`` wins. Repeating a merge changes nothing.

        Rows of pruned days are kept apart: their days can't be rolled up again from them.
        """
        self.recover()
        # Used several times below; lost blocks are computed again.
        fresh = maintenance.last_write(batch.select(*READING_COLUMNS, sequence), sequence).withColumn(
            "obs_date", F.col("observed_at").cast("date")).persist()
        pruned = self.pruned_before()
        if pruned:
            self._late.merge(fresh.where(F.col("obs_date") < F.lit(pruned)))
        current = fresh.where(F.col("obs_date") >= F.lit(pruned)) if pruned else fresh
        # The touched dates go into the plan: only their partitions are listed and read.
        touched = current.select("station_id", "obs_date").distinct()
        dates = sorted(r["obs_date"] for r in touched.select("obs_date").distinct().collect())
        if dates:
            self._touched.note(touched)
            stored = self.read(dates).select(*READING_COLUMNS, "obs_date")
            merged = maintenance.upsert(stored, current, coalesce_existing)
            if not self._latest.exists() and self.exists():  # a store older than its table of newest rows
                self.rebuild_latest()
            # Before the rows themselves: once these are staged, nothing else is left to be done for them.
            newest = latest_per_station(current.drop("obs_date"))
            if coalesce_existing:
                newest = maintenance.coalesced(self._latest.latest(), newest)
            self._latest.merge(newest)
            self._overwrite_partitions(merged)
        fresh.unpersist()

    def latest(self) -> DataFrame:
        """The newest row of every station that has any: one row a station, kept up by each merge."""
        if not self._latest.exists() and self.exists():
            self.rebuild_latest()
        return self._latest.latest()

    def rebuild_latest(self) -> None:
        """Take the newest rows from all history, once for a store that lacks their table."""
        self._latest.merge(latest_per_station(self.read().drop("obs_date")))

    def late(self) -> DataFrame | None:
        """Rows that came after their day was pruned."""
        return self._late.read() if self._late.exists() else None

    def touched(self) -> DataFrame | None:
        """(station_id, obs_date) merged since the last rollup."""
        return self._touched.read() if self._touched.exists() else None

    def forget_touched(self) -> None:
        self._delete(self._touched.path)

    def pruned_before(self) -> dt.date | None:
        """Days before this one have been pruned."""
        path, fs = self._at(f"{self.path}__pruned")
        if not fs.exists(path):
            return None
        days = [dt.date.fromisoformat(s.getPath().getName()) for s in fs.listStatus(path)]
        return max(days) if days else None

    def horizon(self) -> dt.datetime | None:
        """From here on the raw rows are whole: since the last prune, or ever if there was none."""
        if not self.partitions():
            return None
        return dt.datetime.combine(self.pruned_before() or dt.date(1970, 1, 1), dt.time())

    def prune(self, as_of: dt.datetime, retention_days: int = RETENTION_DAYS) -> int:
        """Drop whole dates past retention; returns the rows dropped."""
        self.recover()
        cutoff = maintenance.prune_cutoff(as_of, retention_days).date()
        # Recorded first: an interrupted prune must not pass for whole days.
        mark, fs = self._at(f"{self.path}__pruned/{max(cutoff, self.pruned_before() or cutoff)}")
        fs.create(mark, True).close()
        gone = [d for d in self.partitions() if d < cutoff]
        pruned = self.read(gone).count() if gone else 0
        self.drop_before(cutoff)
        self._latest.forget_before(dt.datetime.combine(cutoff, dt.time()))
        return pruned

    def remove_stations(self, removed: DataFrame) -> None:
        """Delete the given stations (station_id) from the store and all that lies beside it."""
        super().remove_stations(removed)
        for beside in (self._latest, self._late, self._touched):
            beside.remove_stations(removed)


class DailyStore(PartitionedStore):
    """Daily rollup by month of the station-local day, unique on station and day."""

    partition, order = "day_month", ("station_id", "day")

    def __init__(self, spark: SparkSession, path: str, station_id: T.DataType | None = None,
                 row_group_bytes: int = ROW_GROUP_BYTES):
        super().__init__(spark, path, daily_schema(station_id or T.StringType()), row_group_bytes)

    def merge(self, readings: ReadingStore, stations: DataFrame) -> None:
        """Recompute the local days that merges have touched since the last rollup."""
        self.recover()
        readings.recover()
        touched = readings.touched()
        horizon = readings.horizon()
        if touched is None or horizon is None:
            return
        dates = sorted(r["obs_date"] for r in touched.select("obs_date").distinct().collect())
        near = maintenance.dates_near(dates)
        raw = readings.read(near).join(touched.select("station_id").distinct(), "station_id", "left_semi")
        months = sorted({(d + n * ONE_DAY).replace(day=1) for d in dates for n in (-1, 0, 1)})
        self._refresh(raw, stations, horizon, months, maintenance.days_touched(touched))
        readings.forget_touched()

    def rebuild(self, readings: ReadingStore, stations: DataFrame) -> None:
        """Recompute every day the raw store still holds in full."""
        self.recover()
        readings.recover()
        horizon = readings.horizon()
        if horizon is None:
            return
        days = readings.partitions()
        # A local day starts at most a day before its first UTC date and ends at most one after.
        first, last = days[0] - ONE_DAY, days[-1] + ONE_DAY
        months, month = [], first.replace(day=1)
        while month <= last:
            months.append(month)
            month = (month + 32 * ONE_DAY).replace(day=1)
        self._refresh(readings.read(), stations, horizon, months)
        readings.forget_touched()

    def _refresh(self, raw: DataFrame, stations: DataFrame, horizon: dt.datetime, months: list[dt.date],
                 only: DataFrame | None = None) -> None:
        rows = maintenance.rollup_refresh(self.read(months), raw, stations, horizon, only)
        self._overwrite_partitions(rows.select(*DAILY_COLUMNS).withColumn("day_month", F.trunc("day", "month")))


def roll_up_and_prune(readings: ReadingStore, daily: DailyStore, stations: DataFrame, as_of: dt.datetime,
                      retention_days: int = RETENTION_DAYS) -> int:
    """The nightly job: refresh the rollup, then prune raw rows; returns the rows pruned."""
    daily.merge(readings, stations)
    return readings.prune(as_of, retention_days)


def backfill_rollup(readings: ReadingStore, daily: DailyStore, stations: DataFrame) -> None:
    """Recompute the rollup after a schema change, pruning nothing."""
    daily.rebuild(readings, stations)


def delete_stations(readings: ReadingStore, daily: DailyStore, stations: DataFrame, requested: DataFrame) -> DataFrame:
    """Delete the requested stations' rows from both stores; returns the dimension without them.

    The primary station stays, with all its rows.
    """
    removed = maintenance.removable(stations, requested)
    readings.remove_stations(removed)
    daily.remove_stations(removed)
    return maintenance.without_stations(stations, removed)

"""Bright-sunshine hours from elapsed time, with gaps capped at half an hour.

The interval after a reading counts when the reading is sunny. The next reading is never
sought over a station's whole history in one task: readings are cut into hours (or, for
figures per reading, into chunks that see half an hour of the next one), so a busy
station spreads over as many tasks as it has hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldobs.functions import clock, text
from fieldobs.functions.rounding import js_round
from fieldobs.operators import buckets, scan
from fieldobs.operators.daily import is_sunny

# Fixed value: longest interval credited to one reading.
MAX_GAP_MINUTES = 30
GAP_US = MAX_GAP_MINUTES * 60_000_000
HOUR_US = 3_600_000_000
# Chunk of the per-reading form: each is read together with GAP_US of the next one.
CHUNK_US = 2 * HOUR_US


def _credit(solar: Column, here_us: Column, next_us: Column) -> Column:
    """Sunny microseconds until the next reading; null where there is no next reading."""
    gap = F.least(next_us - here_us, F.lit(GAP_US))
    return F.when(next_us.isNotNull(), F.when(is_sunny(solar), gap).otherwise(F.lit(0)))


def _timed(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their instant in microseconds, their UTC hour, whether they have a solar
    value (``lit``), and the credit up to the next such row of the hour: null on the last."""
    us = clock.micros(F.col("observed_at"))
    rows = (readings.withColumn("us", us)
            .withColumn("hour", F.floor(F.col("us") / F.lit(HOUR_US)))
            .withColumn("lit", F.col("solar_radiation").isNotNull()))
    w = Window.partitionBy(*keys, "hour", "lit").orderBy("us")
    credit = _credit(F.col("solar_radiation"), F.col("us"), F.lead("us").over(w))
    return rows.withColumn("credit", F.when(F.col("lit"), credit))


def _hour_summaries(rows: DataFrame, keys: list[str], *carry: Column) -> DataFrame:
    """Per hour: samples, inner credit, and the credit of its last row up to the next hour.

    What crosses hours is settled on these summaries, whose number depends on elapsed
    time only. Grouped like the window before it, so the rows are not shuffled again.
    """
    hours = rows.groupBy(*keys, "hour", "lit").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("credit"), F.lit(0)).alias("inner"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max_by("solar_radiation", "us").alias("last_solar"), *carry)
    # Hours with solar values sort last, so the row after one is the next of them.
    w = Window.partitionBy(*keys).orderBy("lit", "hour")
    closing = _credit(F.col("last_solar"), F.col("last_us"), F.lead("first_us").over(w))
    return hours.withColumn("closing", F.coalesce(F.when(F.col("lit"), closing), F.lit(0)))


def _hours_1dp(us: Column) -> Column:
    return js_round(us / F.lit(float(HOUR_US)), 1)


def _moment(metric: str, highest: bool) -> tuple[Column, Column]:
    """The (rank, instant) of a metric's extreme, per hour and over the hours: the earliest wins a tie."""
    edge = F.max(metric) if highest else F.min(metric)
    here = F.col(metric) == F.col("_high" if highest else "_low")
    found = F.struct((-edge if highest else edge).alias("rank"), F.min(F.when(here, F.col("us"))).alias("us"))
    name = "high" if highest else "low"
    return F.when(edge.isNotNull(), found), F.min(name)


def elapsed_by(readings: DataFrame, keys: list[str], carry: dict[str, tuple[Column, Column]] | None = None,
               extremes: str | None = None) -> DataFrame:
    """Hours per key with readings; null below two solar readings.

    Intervals that leave the key (a station's midnight, when the day is a key) are dropped.
    ``carry`` adds aggregates to the same pass: name -> (per hour, over the hours). ``extremes``
    names a metric whose highest and lowest value come along, as ``high`` and ``low`` with
    their (rank, us); they are sought in the same hours, so no row is shuffled for them.
    """
    carry = carry or {}
    rows = _timed(readings, keys)
    if extremes:
        hour = Window.partitionBy(*keys, "hour", "lit")
        rows = rows.withColumn("_high", F.max(extremes).over(hour)).withColumn("_low", F.min(extremes).over(hour))
        carry = {**carry, "high": _moment(extremes, True), "low": _moment(extremes, False)}
    hours = _hour_summaries(rows, keys, *[part.alias(name) for name, (part, _) in carry.items()])
    lit = F.col("lit")
    total = F.sum(F.when(lit, F.col("inner") + F.col("closing")))
    return hours.groupBy(*keys).agg(
        F.when(F.sum(F.when(lit, F.col("n"))) >= 2, _hours_1dp(total)).alias("sunshine_hours"),
        *[whole.alias(name) for name, (_, whole) in carry.items()])


def sunshine_elapsed(readings: DataFrame) -> DataFrame:
    """Hours of sunshine per station over the window; null without enough solar readings."""
    return elapsed_by(readings.select("station_id", "observed_at", "solar_radiation"), ["station_id"])


def sunshine_by_day(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Hours per station and local day with readings; a midnight-crossing interval is dropped."""
    local = scan.with_local_time(readings.select("station_id", "observed_at", "solar_radiation"), stations)
    days = elapsed_by(local.withColumnRenamed("local_day", "day"), ["station_id", "day"])
    return days.withColumn("label", text.axis_day(F.col("day")))


def sunshine_latest_day(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Figure of each station's most recent local day (at most one row per day is ranked)."""
    w = Window.partitionBy("station_id").orderBy(F.desc("day"))
    return (sunshine_by_day(readings, stations)
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("station_id", "day", "sunshine_hours"))


def sunshine_latest_daily(daily: DataFrame) -> DataFrame:
    """The same figure from rollup rows: that of each station's last day, null when it has none."""
    return daily.groupBy("station_id").agg(
        F.max("day").alias("day"), F.max_by("sunshine_hours", "day").alias("sunshine_hours"))


def reading_credits(readings: DataFrame, stations: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Every solar reading with the sunny microseconds credited to it, and its local time.

    The next reading is sought over the station's whole window, so an interval crossing
    midnight belongs to the earlier day. A gap counts for half an hour at most, so a chunk
    needs only the first half hour of the next chunk: those rows are copied into it. A
    reading with nothing in sight is credited the cap, unless it is its station's last.
    ``chunk_us`` may be narrowed, down to the half hour, for denser feeds.
    """
    if chunk_us < GAP_US:
        raise ValueError("a chunk must hold the longest credited gap")
    us = clock.micros(F.col("observed_at"))
    solar = (readings.where(F.col("solar_radiation").isNotNull())
             .select("station_id", "observed_at", "solar_radiation", us.alias("us")))
    chunk = F.floor(F.col("us") / F.lit(chunk_us))
    early = F.col("us") - chunk * F.lit(chunk_us) < GAP_US
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("copy"))
    before = F.struct((chunk - 1).alias("chunk"), F.lit(True).alias("copy"))
    places = F.when(early, F.array(own, before)).otherwise(F.array(own))
    placed = solar.withColumn("p", F.explode(places)).select(
        "station_id", "observed_at", "solar_radiation", "us", "p.chunk", "p.copy")
    w = Window.partitionBy("station_id", "chunk").orderBy("us")
    rows = placed.withColumn("next_us", F.lead("us").over(w)).where(~F.col("copy"))
    # Keyed like the window, so the rows stay where they are.
    last = (solar.groupBy("station_id").agg(F.max("us").alias("last_us"))
            .withColumn("chunk", F.floor(F.col("last_us") / F.lit(chunk_us))))
    rows = rows.join(last, ["station_id", "chunk"], "left")
    more = F.col("last_us").isNull() | (F.col("us") < F.col("last_us"))
    until = F.when(more, F.coalesce("next_us", F.col("us") + F.lit(GAP_US)))
    credit = F.coalesce(_credit(F.col("solar_radiation"), F.col("us"), until), F.lit(0))
    return scan.with_local_time(rows.select("station_id", "observed_at", credit.alias("credit")), stations)


def _hundredths(credit: Column) -> Column:
    """Hours to two digits, as a whole number of hundredths: exact, and cheap for every row."""
    return F.floor((credit * 100 + HOUR_US // 2) / F.lit(float(HOUR_US)))


def sunshine_series_raw(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Per reading: hours credited, two digits."""
    return reading_credits(readings, stations).select(
        "station_id", "observed_at", F.col("local_day").alias("day"),
        (_hundredths(F.col("credit")) / 100.0).alias("hours"),
        F.date_format("local_ts", "HH:mm").alias("label"))


def sunshine_series_6h(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Hours credited to readings of each six-hour wall-clock bucket, one digit.

    Summed from within-bucket credits and hour closings, so only summaries are joined.
    """
    solar = readings.where(F.col("solar_radiation").isNotNull()).select("station_id", "observed_at", "solar_radiation")
    local = scan.with_local_time(solar, stations)
    rows = _timed(local.withColumn("bucket_start", clock.six_hour_start(F.col("local_ts"))), ["station_id"])
    # The bucket an hour's last reading falls in takes the hour's closing interval.
    inner = F.coalesce(F.sum("credit"), F.lit(0)).alias("credit")
    by_bucket = (rows.groupBy("station_id", "hour", "bucket_start")
                 .agg(inner, F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                      F.max_by("solar_radiation", "us").alias("last_solar")))
    w = Window.partitionBy("station_id").orderBy("first_us")
    # Inside an hour the lead already reached the next bucket's first reading.
    same_hour = F.lead("hour").over(w) == F.col("hour")
    closing = _credit(F.col("last_solar"), F.col("last_us"), F.lead("first_us").over(w))
    total = F.col("credit") + F.when(F.coalesce(same_hour, F.lit(False)), F.lit(0)).otherwise(
        F.coalesce(closing, F.lit(0)))
    sums = (by_bucket.withColumn("total", total).groupBy("station_id", "bucket_start")
            .agg(_hours_1dp(F.sum("total")).alias("hours")))
    return buckets.with_6h_labels(sums)


def sunshine_cumulative_6h(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Running total of the six-hour series, restarting at local midnight, one digit.

    A day has at most a handful of buckets, so a window over them is small.
    """
    series = sunshine_series_6h(readings, stations).withColumn("day", F.col("bucket_start").cast("date"))
    so_far = Window.partitionBy("station_id", "day").orderBy("bucket_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return series.select("station_id", "day", "bucket_start", "label", "day_label", "full_label",
                         js_round(F.sum("hours").over(so_far), 1).alias("cumulative"))


def sunshine_cumulative(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Running total of the two-digit series, restarting at local midnight, one digit.

    A window holds one day of one station, so a busy station spreads over its days. All in
    whole hundredths.
    """
    keys = ["station_id", "day"]
    rows = reading_credits(readings, stations).select(
        "station_id", F.col("local_day").alias("day"), "observed_at", "local_ts",
        _hundredths(F.col("credit")).alias("step"))
    so_far = Window.partitionBy(*keys).orderBy("observed_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tenths = F.floor((F.sum("step").over(so_far) + 5) / 10.0)
    return rows.select(*keys, "observed_at", F.date_format("local_ts", "HH:mm").alias("label"),
                       (tenths / 10.0).alias("cumulative"))

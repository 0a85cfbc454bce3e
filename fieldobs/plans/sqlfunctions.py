"""Rollups as SQL table functions over registered views.

    register(spark, readings, stations)
    spark.sql("SELECT * FROM readings_daily(7, TIMESTAMP_NTZ'2024-01-20 00:00:00') ORDER BY day")

The functions are SQL themselves: Spark puts their bodies into the caller's plan, so arguments reach
the scan as filters, and a caller may join them to its own tables with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldobs.operators.daily import CADENCE_MINUTES, LOWS, MEANS, PEAKS, SUNNY_WM2
from fieldobs.schema import DAILY_METRICS
from fieldobs.session import use_utc

_DAY = "CAST(convert_timezone('UTC', coalesce(s.timezone, 'UTC'), r.observed_at) AS DATE)"


def _rounded(value: str, digits: int) -> str:
    """``pg_round`` in SQL."""
    return f"CAST(round(try_cast({value} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def _bearing() -> str:
    """``circular_mean`` in SQL."""
    east, north = (f"CAST(try_cast(avg({part}(radians(r.wind_dir))) AS DECIMAL(20,12)) AS DOUBLE)" for part in ("sin", "cos"))
    return f"{_rounded(f'degrees(atan2({east}, {north})) + 360.0D', 6)} % 360.0D"


def _metrics() -> dict[str, str]:
    """``daily_aggregates`` in SQL, by column."""
    values = {out: _rounded(f"{agg}(r.{src})", digits)
              for agg, columns in (("avg", MEANS), ("max", PEAKS), ("min", LOWS)) for out, (src, digits) in columns.items()}
    hours = _rounded(f"count_if(r.solar_radiation >= {SUNNY_WM2}) * {CADENCE_MINUTES}.0D / 60.0D", 1)
    return values | {"wind_dir": _bearing(),
                     "sunshine_hours": f"CASE WHEN count(r.solar_radiation) > 0 THEN {hours} END"}


def register(spark: SparkSession, readings: DataFrame, stations: DataFrame,
             views: tuple[str, str] = ("readings", "stations")) -> None:
    """Register the two tables as temporary views and, over them, the temporary functions

    - ``readings_daily(station, since)``: a row per local day of one station, from its rows at or after an instant
      (the first day may be partial);
    - ``rollup_days(since)``: the same of every station, with its ``station_id``.

    An unknown station gives no rows, a null argument neither.
    """
    use_utc(spark)
    for view, table in zip(views, (readings, stations)):
        table.createOrReplaceTempView(view)
    key = readings.schema["station_id"].dataType.simpleString()
    columns = ", ".join(f"{m} DOUBLE" for m in DAILY_METRICS)
    values = _metrics()
    chosen = ", ".join(f"{values[m]} AS {m}" for m in DAILY_METRICS)
    rows = f"FROM {views[0]} r JOIN {views[1]} s ON s.station_id = r.station_id WHERE r.observed_at >= since"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION readings_daily(station {key}, since TIMESTAMP_NTZ)
        RETURNS TABLE (day DATE, {columns})
        RETURN SELECT {_DAY} AS day, {chosen} {rows} AND r.station_id = station GROUP BY {_DAY}""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rollup_days(since TIMESTAMP_NTZ)
        RETURNS TABLE (station_id {key}, day DATE, {columns})
        RETURN SELECT r.station_id, {_DAY} AS day, {chosen} {rows} GROUP BY r.station_id, {_DAY}""")

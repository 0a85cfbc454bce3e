"""Checks and repairs of the station dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldobs.functions import geo

GRID_STEP = 1.0


def known_zones(spark: SparkSession) -> DataFrame:
    """Every zone name the engine accepts: a few hundred rows, fixed by the runtime."""
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    return spark.createDataFrame([(str(n),) for n in sorted(names)], "timezone string")


def tz_validate(stations: DataFrame, zones: DataFrame) -> DataFrame:
    """Flag unknown zone names and replace them with null, so that no job dies on one.

    ``zones`` comes from ``known_zones``, whose size the runtime fixes: it is broadcast.
    """
    known = F.broadcast(zones.select("timezone", F.lit(True).alias("_known")))
    ok = F.col("timezone").isNull() | F.col("_known").isNotNull()
    return (stations.join(known, "timezone", "left")
            .withColumn("zone_valid", ok)
            .withColumn("stated_zone", F.col("timezone"))
            .withColumn("timezone", F.when(F.col("_known").isNotNull(), F.col("timezone")))
            .drop("_known"))


def geo_enrich(points: DataFrame, cells: DataFrame, countries: DataFrame, step: float = GRID_STEP) -> DataFrame:
    """Zone of the grid cell a point lies in, and the zone's country; unknown ones are null.

    ``points`` must not carry ``timezone`` or ``country`` already.
    """
    placed = (points.withColumn("cell_lat", geo.grid_cell(F.col("latitude"), step))
              .withColumn("cell_lon", geo.grid_cell(F.col("longitude"), step)))
    return (placed.join(cells.select("cell_lat", "cell_lon", "timezone"), ["cell_lat", "cell_lon"], "left")
            .join(countries.select("timezone", "country"), "timezone", "left")
            .select(*points.columns, "timezone", "country"))


def backfill_targets(stations: DataFrame) -> DataFrame:
    return stations.where(F.col("latitude").isNull() | F.col("timezone").isNull())


def geo_backfill(stations: DataFrame, found: DataFrame, cells: DataFrame, countries: DataFrame,
                 step: float = GRID_STEP) -> DataFrame:
    """Targets with coordinates filled and zone and country derived anew.

    Both coordinates come from ``found`` when either is missing. ``updated`` is false for
    a target that still has none: it is a miss and keeps what it had.
    """
    lacking = F.col("latitude").isNull() | F.col("longitude").isNull()
    source = found.select("station_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    filled = (backfill_targets(stations).join(source, "station_id", "left")
              .withColumn("_new_lat", F.when(lacking, F.col("_lat")).otherwise(F.col("latitude")))
              .withColumn("_new_lon", F.when(lacking, F.col("_lon")).otherwise(F.col("longitude"))))
    done = F.col("_new_lat").isNotNull() & F.col("_new_lon").isNotNull()
    points = (filled.withColumn("updated", done)
              .withColumn("latitude", F.when(done, F.col("_new_lat")).otherwise(F.col("latitude")))
              .withColumn("longitude", F.when(done, F.col("_new_lon")).otherwise(F.col("longitude")))
              .withColumnsRenamed({"timezone": "_tz", "country": "_country"})
              .drop("_lat", "_lon", "_new_lat", "_new_lon"))
    derived = geo_enrich(points, cells, countries, step)
    return (derived.withColumn("timezone", F.when(F.col("updated"), F.col("timezone")).otherwise(F.col("_tz")))
            .withColumn("country", F.when(F.col("updated"), F.col("country")).otherwise(F.col("_country")))
            .select(*stations.columns, "updated"))


def backfill_report(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count(F.lit(1)).alias("checked"), F.count_if("updated").alias("updated"),
                       F.count_if(~F.col("updated")).alias("misses"))


def apply_backfill(stations: DataFrame, targets: DataFrame) -> DataFrame:
    """The whole dimension with the repaired rows in place."""
    fixed = targets.where("updated").drop("updated")
    return stations.join(fixed.select("station_id"), "station_id", "left_anti").unionByName(fixed)

"""Regions and network-wide superlatives, over one card row per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.functions import text
from fieldobs.functions.rounding import js_round, settle
from fieldobs.operators.latest import first_by

# Fixed value: region of stations without a country.
OTHER = "Other"
# Ties go to the station listed first.
LISTED = (F.desc, "is_primary"), (F.asc, "created_at"), (F.asc, "station_id")


def _listed_order() -> list[Column]:
    return [direction(name) for direction, name in LISTED]


def region_of(country: Column) -> Column:
    return F.coalesce(country, F.lit(OTHER))


def region_stats(cards: DataFrame) -> DataFrame:
    """Per region: stations with data, mean of their (rounded) means, warmest, windiest, most rain.

    One grouped pass; the leaders are the least (-value, listing order) structs.
    """
    c = F.col
    live = c("observed_at").isNotNull()

    def leader(metric: str) -> Column:
        entry = F.struct((-c(metric)).alias("below"), (~c("is_primary")).alias("later"), "created_at", "station_id",
                         "name", c(metric).alias("value"))
        return F.min(F.when(live & c(metric).isNotNull(), entry))

    regions = cards.groupBy(region_of(c("country")).alias("region")).agg(
        F.count("observed_at").alias("station_count"),
        js_round(F.avg(F.when(live, c("temp_mean"))), 1).alias("avg_temp"),
        js_round(F.max(F.when(live, c("rain"))), 1).alias("max_rain"),
        leader("temp_high").alias("warm"), leader("wind_mean").alias("wind"))
    return regions.select("region", "station_count", "avg_temp", "max_rain",
                          c("warm.name").alias("warmest"), c("warm.value").alias("warmest_value"),
                          c("wind.name").alias("windiest"), c("wind.value").alias("windiest_value"))


def region_headline(regions: DataFrame) -> DataFrame:
    n, c = text.number_text, F.col
    count = c("station_count")
    line = text.joined(
        F.concat(count.cast("string"), text.plural(count, "station")),
        text.sentence("avg ", n(c("avg_temp")), "° (today)"),
        F.when(count > 1, text.sentence("warmest ", c("warmest"), " ", n(c("warmest_value")), "°")),
        F.when(c("windiest_value") > 0,
               text.sentence("windiest ", c("windiest"), " ", n(c("windiest_value")), " km/h")),
        F.when(c("max_rain") > 0, text.sentence("up to ", n(c("max_rain")), " mm rain")))
    return regions.select("region", line.alias("headline"))


def network_highlights(cards: DataFrame) -> DataFrame:
    """Superlative stations of the day. Sun, rain and gust are listed only above zero."""
    c = F.col
    swing = settle(c("temp_high") - c("temp_low"))
    # label, value to rank by, value to show, unit, whether it must be positive
    entries = [
        ("Hottest", c("temp_high"), c("temp_high"), "°", False),
        ("Coolest", -c("temp_low"), c("temp_low"), "°", False),
        ("Sunniest", c("sunshine"), c("sunshine"), " h", True),
        ("Wettest", c("rain"), js_round(c("rain"), 1), " mm", True),
        ("Strongest gust", c("gust"), c("gust"), " km/h", True),
        ("Biggest swing", swing, js_round(swing, 1), "°", False),
    ]
    structs = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"),
                 F.when(rank > 0, rank).alias("rank") if positive else rank.alias("rank"),
                 F.concat(text.number_text(shown), F.lit(unit)).alias("value"))
        for i, (label, rank, shown, unit, positive) in enumerate(entries)]
    rows = (cards.select("station_id", "name", "country", "is_primary", "created_at",
                         F.explode(F.array(*structs)).alias("e"))
            .select("*", "e.*").where(c("rank").isNotNull()))
    best = first_by(rows, ["label"], F.desc("rank"), *_listed_order())
    return best.select("position", "label", "value", "station_id",
                       F.concat_ws(text.SEPARATOR, "name", region_of(c("country"))).alias("sub"))


def warmest_region(cards: DataFrame) -> DataFrame:
    """The region with the highest mean of station means, when two or more have one.

    A tie goes to the region listed first. Both steps are aggregates that combine map-side.
    """
    regions = (cards.where(F.col("temp_mean").isNotNull())
               .groupBy(region_of(F.col("country")).alias("region"))
               .agg(js_round(F.avg("temp_mean"), 1).alias("avg_temp"),
                    F.min(F.struct((~F.col("is_primary")).alias("later"), "created_at", "station_id")).alias("seen")))
    best = regions.agg(
        F.count(F.lit(1)).alias("regions"),
        F.min(F.struct((-F.col("avg_temp")).alias("coldness"), "seen", "region", "avg_temp")).alias("best"))
    return best.where(F.col("regions") >= 2).select("best.region", "best.avg_temp")


def region_order(stations: DataFrame) -> DataFrame:
    """Regions as listed: the primary station's country, then by name, "Other" last."""
    # A primary station without a country promotes nothing.
    home = F.coalesce(F.max(F.col("is_primary") & F.col("country").isNotNull()), F.lit(False))
    groups = (stations.groupBy(region_of(F.col("country")).alias("region"))
              .agg(F.count(F.lit(1)).alias("stations"), home.alias("home")))
    place = F.when(F.col("home"), 0).when(F.col("region") == OTHER, 2).otherwise(1)
    return groups.select("region", "stations", place.alias("place")).orderBy("place", "region")

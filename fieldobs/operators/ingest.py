"""Payloads to canonical readings, enrichment, batch outcomes, station records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldobs.schema import (DEVICE_PAYLOAD, MEASUREMENTS, PWS_PAYLOAD, READING_COLUMNS,
                             SOURCE_DEVICE, SOURCE_PWS)

# Payload field of each measurement.
PWS_FIELDS = {
    "temp_c": "metric.temp", "humidity": "humidity", "dewpoint_c": "metric.dewpt",
    "windchill_c": "metric.windChill", "heat_index_c": "metric.heatIndex",
    "wind_speed_kph": "metric.windSpeed", "wind_gust_kph": "metric.windGust", "wind_dir": "winddir",
    "pressure_mb": "metric.pressure", "precip_rate_mm": "metric.precipRate",
    "precip_total_mm": "metric.precipTotal", "uv": "uv", "solar_radiation": "solarRadiation",
    "elevation": "metric.elev",
}
# Airport reports carry averages where devices carry momentary wind.
DEVICE_FIELDS = {
    "temp_c": ("temp",), "humidity": ("hum",), "dewpoint_c": ("dew",), "windchill_c": ("chill",),
    "heat_index_c": ("heat",), "wind_speed_kph": ("wspd", "wspdavg"), "wind_gust_kph": ("wspdhi",),
    "wind_dir": ("wdir", "wdiravg"), "pressure_mb": ("bar",), "precip_rate_mm": ("rainrate",),
    "precip_total_mm": ("rain",), "uv": ("uvi",), "solar_radiation": ("solarrad",),
    "temp_indoor_c": ("tempin",), "humidity_indoor": ("humin",),
}
METAR_FORM = r"(?i)^[a-z]{4}$"
DEVICE_KEY_PREFIX = "WC-"
# Only instants in this range are stored: from the first to a day after the present.
EARLIEST = "1970-01-01 00:00:00"
LATEST_AHEAD = "1 day"
# Measurements from here on are no reading of any sensor and count as missing.
ABSURD = 1e9
STRICT_JSON = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def feels_like(windchill: Column, heat_index: Column, temp: Column) -> Column:
    return F.coalesce(windchill, heat_index, temp)


def canonical(rows: DataFrame, *extra: str) -> DataFrame:
    """Any partial row as the 19 columns: missing and absurd ones null, whole-number ones rounded.

    ``extra`` names batch bookkeeping columns to carry along.
    """
    def column(name: str, kind: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast(kind).alias(name)
        value = F.when(F.abs(F.col(name)) < ABSURD, F.col(name))
        return (F.round(value).try_cast("int") if kind == "int" else value.cast(kind)).alias(name)

    return rows.select("station_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
                       *[column(name, kind) for name, kind in MEASUREMENTS.items()], *extra)


def canonical_union(*branches: DataFrame) -> DataFrame:
    """One batch from branches with different columns."""
    whole = branches[0]
    for branch in branches[1:]:
        whole = whole.unionByName(branch, allowMissingColumns=True)
    return canonical(whole)


def _strict(payload: Column, kind: T.StructType) -> Column:
    """The one object that the whole text is, as an array of none or one.

    Read as the content of an array, so that anything after the object makes it malformed
    or a second element. The check is a filter over the parsed form, which thus stands in the plan once.
    """
    parsed = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), T.ArrayType(kind), STRICT_JSON)
    return F.get(F.filter(F.array(parsed), lambda objects: F.size(objects) == 1), F.lit(0))


def _pws_observation(payload: Column) -> Column:
    """The first observation as an array of none or one."""
    return F.slice(F.get(_strict(payload, PWS_PAYLOAD), F.lit(0))["observations"], 1, 1)


def _pws_instant(observation: Column) -> Column:
    return observation["obsTimeUtc"].try_cast("timestamp").cast("timestamp_ntz")


def _device_values(payload: Column) -> Column:
    """The payload as an array of none or one. The text itself must open the object:
    leading blanks are not accepted."""
    looks_right = payload.startswith("{") & F.rtrim(payload).endswith("}")
    return F.when(looks_right, _strict(payload, DEVICE_PAYLOAD))


def _device_instant(values: Column) -> Column:
    epoch = values["epoch"]
    return F.when(F.abs(epoch) <= 1e11, F.timestamp_seconds(epoch)).cast("timestamp_ntz")


def plausible(at: Column) -> Column:
    """An instant a reading may bear; a clock that runs wild, or milliseconds for seconds, gives none."""
    latest = (F.current_timestamp() + F.expr(f"INTERVAL {LATEST_AHEAD}")).cast("timestamp_ntz")
    return F.when((at >= F.lit(EARLIEST).cast("timestamp_ntz")) & (at <= latest), at)


def _parsed(payloads: DataFrame, parsed: Column, at: Column) -> DataFrame:
    """Payloads with their parsed form and instant, null where unusable.

    Exploding the array of none or one parses each text once: no filter moves below it.
    """
    return payloads.select("*", F.explode_outer(parsed).alias("_o")).withColumn("observed_at", plausible(at))


def _parsed_pws(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, _pws_observation(F.col("payload")), _pws_instant(F.col("_o")))


def _parsed_device(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, _device_values(F.col("payload")), _device_instant(F.col("_o")))


def _accepted(payloads: DataFrame, parsed: DataFrame, values: dict[str, Column]) -> DataFrame:
    keep = [c for c in payloads.columns if c != "payload"]
    rows = parsed.where(F.col("observed_at").isNotNull()).select(
        *keep, "observed_at", *[v.alias(name) for name, v in values.items()])
    return canonical(rows, *[c for c in keep if c not in READING_COLUMNS])


def _rejected(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("observed_at").isNull()).select(*payloads.columns)


def _with_feels_like(values: dict[str, Column]) -> dict[str, Column]:
    return values | {"feels_like_c": feels_like(values["windchill_c"], values["heat_index_c"], values["temp_c"])}


def _pws_values() -> dict[str, Column]:
    return _with_feels_like({name: F.col(f"_o.{field}") for name, field in PWS_FIELDS.items()})


def _device_values_by_name() -> dict[str, Column]:
    return _with_feels_like({
        name: F.coalesce(*[F.col(f"_o.{f}") for f in fields]) for name, fields in DEVICE_FIELDS.items()})


def ingest_pws(payloads: DataFrame) -> DataFrame:
    """Accepted readings of nested observation payloads; only the first observation counts."""
    return _accepted(payloads, _parsed_pws(payloads), _pws_values())


def ingest_device(payloads: DataFrame) -> DataFrame:
    """Accepted readings of flat device and airport payloads."""
    return _accepted(payloads, _parsed_device(payloads), _device_values_by_name())


def rejected_pws(payloads: DataFrame) -> DataFrame:
    """Payloads without a usable observation, for the quarantine table."""
    return _rejected(payloads, _parsed_pws(payloads))


def rejected_device(payloads: DataFrame) -> DataFrame:
    return _rejected(payloads, _parsed_device(payloads))


def by_source(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed payloads of personal stations, of devices, and of no stated source: every row is in one of them."""
    source, device = F.col("source"), F.col("source") == SOURCE_DEVICE
    return (payloads.where(F.coalesce(~device, F.lit(False))), payloads.where(F.coalesce(device, F.lit(False))),
            payloads.where(source.isNull()))


def ingest_mixed(payloads: DataFrame) -> DataFrame:
    """Both payload kinds of one landing table, by its ``source`` column, as one batch."""
    pws, device, _ = by_source(payloads)
    return canonical_union(ingest_pws(pws), ingest_device(device))


def rejected_mixed(payloads: DataFrame) -> DataFrame:
    """What ``ingest_mixed`` leaves out: together they account for every landed row."""
    pws, device, unknown = by_source(payloads)
    return rejected_pws(pws).unionByName(rejected_device(device)).unionByName(unknown)


class Intake:
    """One landed batch, each payload parsed once for both its readings and its rejects."""

    def __init__(self, payloads: DataFrame):
        pws, device, self._unknown = by_source(payloads)
        self._pws, self._device = _parsed_pws(pws).persist(), _parsed_device(device).persist()
        self._payloads = payloads

    def accepted(self, *extra: str) -> DataFrame:
        """Readings, with the named landing columns."""
        pws = _accepted(self._payloads, self._pws, _pws_values())
        device = _accepted(self._payloads, self._device, _device_values_by_name())
        return pws.unionByName(device).select(*READING_COLUMNS, *extra)

    def rejected(self) -> DataFrame:
        return _rejected(self._payloads, self._pws).unionByName(
            _rejected(self._payloads, self._device)).unionByName(self._unknown)

    def close(self) -> None:
        self._pws.unpersist()
        self._device.unpersist()


def indoor_enrich(batch: DataFrame, indoor: DataFrame, stations: DataFrame) -> DataFrame:
    """Overwrite the indoor columns of the primary station's rows from a second feed.

    The feed (station_id, poll_id, indoor columns) counts for the primary station only and
    is matched on station and poll; a poll it did not answer leaves the row alone.
    """
    key = ["station_id", "poll_id"]
    primary = stations.where("is_primary").select("station_id")
    feed = indoor.join(primary, "station_id", "left_semi").select(
        *key, F.lit(True).alias("_fed"),
        F.col("temp_indoor_c").alias("_temp"), F.col("humidity_indoor").alias("_hum"))
    fed = F.col("_fed").isNotNull()
    return (batch.join(feed, key, "left")
            .withColumn("temp_indoor_c", F.when(fed, F.col("_temp")).otherwise(F.col("temp_indoor_c")))
            .withColumn("humidity_indoor", F.when(fed, F.col("_hum")).otherwise(F.col("humidity_indoor")))
            .select(*batch.columns))


def polled_stations(stations: DataFrame) -> DataFrame:
    """Stations a collection run asks: device stations need a source id."""
    device = F.col("source") == SOURCE_DEVICE
    return stations.where(~device | F.col("source_id").isNotNull()).select(
        "station_id", "source",
        F.when(device, F.col("source_id")).otherwise(F.col("wunderground_id")).alias("station"))


def collect_outcomes(stations: DataFrame, accepted: DataFrame, stored: bool = True) -> DataFrame:
    """Per polled station: ok, no_data, or error when the batch could not be stored."""
    arrived = accepted.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce(F.col("rows"), F.lit(0))
    status = F.when(rows > 0, "ok").otherwise("no_data") if stored else F.lit("error")
    return polled_stations(stations).join(arrived, "station_id", "left").select(
        "station_id", "station", status.alias("status"), rows.alias("rows"))


def any_stored(outcomes: DataFrame) -> DataFrame:
    """One row: whether the run stored anything, and its counts by status."""
    status = F.col("status")
    ok = F.count_if(status == "ok")
    return outcomes.agg((ok > 0).alias("any_stored"), ok.alias("ok"),
                        F.count_if(status == "no_data").alias("no_data"),
                        F.count_if(status == "error").alias("error"))


def source_kind(source_id: Column) -> Column:
    return F.when(source_id.rlike(METAR_FORM), "metar").otherwise("device")


def station_conform(requests: DataFrame) -> DataFrame:
    """Dimension rows from add-station requests (name, source, station_id as typed).

    Names and ids are trimmed, requests without either are dropped; any source but the
    device network counts as a personal station. Personal ids and airport codes are
    upper-cased, device ids kept.
    """
    name, raw = F.trim("name"), F.trim("station_id")
    device = F.coalesce(F.col("source") == SOURCE_DEVICE, F.lit(False))
    code = F.when(device & ~raw.rlike(METAR_FORM), raw).otherwise(F.upper(raw))
    rest = [c for c in requests.columns if c not in ("name", "source", "station_id")]
    return requests.where((name != "") & (raw != "")).select(
        name.alias("name"), F.when(device, SOURCE_DEVICE).otherwise(SOURCE_PWS).alias("source"),
        code.alias("source_id"),
        F.when(device, F.concat(F.lit(DEVICE_KEY_PREFIX), code)).otherwise(code).alias("wunderground_id"),
        *rest)

"""Declared schemas of the star: station dimension, readings fact, daily rollup, payloads.

Instants are stored as ``timestamp_ntz`` holding UTC wall-clock time, so parquet
min/max pruning and zone conversion work on the stored column itself.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Stored source kinds.
SOURCE_PWS = "wunderground"
SOURCE_DEVICE = "weathercloud"

_D, _I, _S, _TS = T.DoubleType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec])


STATION = _struct([
    ("station_id", _S), ("name", _S), ("wunderground_id", _S), ("latitude", _D), ("longitude", _D),
    ("is_primary", T.BooleanType()), ("source", _S), ("source_id", _S), ("timezone", _S),
    ("country", _S), ("created_at", _TS),
])

# Column name -> Spark type of every measurement, in storage order.
MEASUREMENTS: dict[str, str] = {
    "temp_c": "double",
    "humidity": "int",
    "dewpoint_c": "double",
    "windchill_c": "double",
    "heat_index_c": "double",
    "wind_speed_kph": "double",
    "wind_gust_kph": "double",
    "wind_dir": "int",
    "pressure_mb": "double",
    "precip_rate_mm": "double",
    "precip_total_mm": "double",
    "uv": "double",
    "solar_radiation": "double",
    "feels_like_c": "double",
    "elevation": "double",
    "temp_indoor_c": "double",
    "humidity_indoor": "int",
}
READING_KEY = ("station_id", "observed_at")
READING_COLUMNS = [*READING_KEY, *MEASUREMENTS]

DAILY_KEY = ("station_id", "day")
DAILY_METRICS = [
    "temp_avg", "temp_min", "temp_max", "temp_indoor_c", "feels_like_c", "dewpoint_c",
    "humidity", "humidity_indoor", "pressure_mb", "wind_speed_kph", "wind_gust_kph", "wind_dir",
    "precip_total_mm", "precip_rate_mm", "uv", "solar_radiation", "sunshine_hours",
]
DAILY_COLUMNS = [*DAILY_KEY, *DAILY_METRICS]


def reading_schema(station_id: T.DataType = _S) -> T.StructType:
    kinds = {"double": _D, "int": _I}
    return _struct([("station_id", station_id), ("observed_at", _TS),
                    *((name, kinds[kind]) for name, kind in MEASUREMENTS.items())])


def daily_schema(station_id: T.DataType = _S) -> T.StructType:
    return _struct([("station_id", station_id), ("day", T.DateType()),
                    *((name, _D) for name in DAILY_METRICS)])


# Field names of the two upstream payload formats.
PWS_PAYLOAD = _struct([("observations", T.ArrayType(_struct([
    ("stationID", _S), ("obsTimeUtc", _S), ("lat", _D), ("lon", _D),
    ("solarRadiation", _D), ("uv", _D), ("winddir", _D), ("humidity", _D),
    ("metric", _struct([
        ("temp", _D), ("heatIndex", _D), ("dewpt", _D), ("windChill", _D), ("windSpeed", _D),
        ("windGust", _D), ("pressure", _D), ("precipRate", _D), ("precipTotal", _D), ("elev", _D),
    ])),
])))])

# A quoted or missing ``epoch`` parses to null, which rejects the payload.
DEVICE_PAYLOAD = _struct([
    ("epoch", _D), ("temp", _D), ("hum", _D), ("dew", _D), ("chill", _D), ("heat", _D),
    ("wspd", _D), ("wspdavg", _D), ("wspdhi", _D), ("wdir", _D), ("wdiravg", _D), ("bar", _D),
    ("rainrate", _D), ("rain", _D), ("uvi", _D), ("solarrad", _D), ("tempin", _D), ("humin", _D),
])

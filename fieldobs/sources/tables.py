"""Scans of the base tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldobs.schema import STATION, daily_schema, reading_schema


def stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATION).parquet(path)


def readings(spark: SparkSession, path: str, station_id: T.DataType | None = None) -> DataFrame:
    """Declared columns only; those that older files lack read as null."""
    return spark.read.schema(reading_schema(station_id or T.StringType())).parquet(path)


def daily(spark: SparkSession, path: str, station_id: T.DataType | None = None) -> DataFrame:
    return spark.read.schema(daily_schema(station_id or T.StringType())).parquet(path)


def landing(spark: SparkSession, path: str) -> DataFrame:
    """Collected payloads as JSON lines: one payload text with its station and source."""
    return spark.read.schema(LANDING).json(path)


LANDING = T.StructType([
    T.StructField("station_id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("ingest_seq", T.LongType()), T.StructField("payload", T.StringType()),
])

import datetime as dt

import pytest
from pyspark.sql import types as T

from fieldobs.schema import reading_schema
from fieldobs.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """Build readings and stations from a few values; everything else is null."""
    class Make:
        schema = reading_schema(T.StringType())

        def readings(self, *rows: dict):
            names = self.schema.fieldNames()
            values = [tuple(at(v) if n == "observed_at" else v for n in names for v in [
                {"station_id": "s", **row}.get(n)]) for row in rows]
            return spark.createDataFrame(values, self.schema)

        def series(self, column: str, pairs, station: str = "s"):
            return self.readings(*[{"station_id": station, "observed_at": t, column: v} for t, v in pairs])

        def stations(self, *rows: dict):
            schema = ("station_id string, name string, wunderground_id string, latitude double, longitude double, "
                      "is_primary boolean, source string, source_id string, timezone string, country string, "
                      "created_at timestamp_ntz")
            names = [part.split()[0] for part in schema.split(", ")]
            base = {"is_primary": False, "source": "wunderground", "created_at": "2024-01-01"}
            values = []
            for row in rows or ({"station_id": "s"},):
                row = {**base, "name": row["station_id"].upper(), "wunderground_id": row["station_id"], **row}
                row["created_at"] = at(row["created_at"])
                values.append(tuple(row.get(n) for n in names))
            return spark.createDataFrame(values, schema)

        def daily(self, *rows: dict):
            from fieldobs.schema import daily_schema

            schema = daily_schema()
            names = schema.fieldNames()
            values = []
            for row in rows:
                row = {"station_id": "s", **row, "day": dt.date.fromisoformat(row["day"])}
                values.append(tuple(row.get(n) for n in names))
            return spark.createDataFrame(values, schema)

    return Make()


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]

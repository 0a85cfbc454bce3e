"""What became of every streamed row: kept, a duplicate, or too late.

Rows behind the watermark (that of the micro-batch before) leave a de-duplicating stream without a trace in its output. Its operators
count them; these counts are written here as a table, one row per micro-batch, so that

    landed = kept + duplicates + late

can be checked against the stream's own table at any time.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

ACCOUNT = "query string, run string, batch long, landed long, duplicates long, late long, kept long"
# Fixed value: the metric of Spark's de-duplicating operators.
_DUPLICATES = "numDroppedDuplicateRows"


def account(progress: dict) -> tuple:
    """The account of one micro-batch, from its progress report.

    Exact for streams whose only stateful operator is ``redelivery_free``: it meets every row by
    itself. An aggregation meets rows combined map-side and would count late groups, not rows.
    """
    operators = progress["stateOperators"]
    landed = progress["numInputRows"]
    duplicates = sum(int(o.get("customMetrics", {}).get(_DUPLICATES, 0)) for o in operators)
    late = sum(int(o["numRowsDroppedByWatermark"]) for o in operators)
    return (progress["name"] or progress["id"], progress["runId"], progress["batchId"], landed, duplicates, late,
            landed - duplicates - late)


class Accounts(StreamingQueryListener):
    """Writes the account of every micro-batch of the streams named ``names`` (all, if not given) to a parquet table.

    ``spark.streams.addListener(Accounts(spark, table))``. Batches without a row are left out.
    """

    def __init__(self, spark: SparkSession, table: str, names: set[str] | None = None):
        self.spark, self.table, self.names = spark, table, names
        self._open: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._changed:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if progress["numInputRows"] and (self.names is None or progress["name"] in self.names):
            self.spark.createDataFrame([account(progress)], ACCOUNT).coalesce(1).write.mode("append").parquet(self.table)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._open.discard(str(event.runId))
            self._changed.notify_all()

    def settled(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until the accounts of a query that has ended are written; its reports come with a delay."""
        until, run = time.monotonic() + seconds, str(query.runId)
        with self._changed:
            while run in self._open and time.monotonic() < until:
                self._changed.wait(0.1)
            return run not in self._open


def accounts(spark: SparkSession, table: str) -> DataFrame:
    """The accounts so far, each batch once: a batch that was run again is reported again by its later run."""
    rows = spark.read.schema(ACCOUNT).parquet(table)
    return rows.dropDuplicates(["query", "batch"])


def totals(spark: SparkSession, table: str) -> DataFrame:
    counts = [F.sum(c).alias(c) for c in ("landed", "kept", "duplicates", "late")]
    return accounts(spark, table).groupBy("query").agg(*counts)

"""Helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldobs.session import work_dir

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders staged in the innermost open ``scratch`` block.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared work folder and read it again.

    Cuts the lineage and lets several later plans read one result. The folder is on
    storage every executor sees, so a lost executor loses nothing of it. It stays, unless
    a ``scratch`` block is open.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged in this block is deleted when it ends, but for frames staged by the function it yields.

    No frame that reads the others may leave the block. Those that stay belong to the block around it, if any.
    """
    made: list[str] = []
    stay: list[str] = []
    token = _passing.set(made)

    def keep(df: DataFrame, purpose: str) -> DataFrame:
        frame = staged(df, purpose)
        stay.append(made.pop())
        return frame

    try:
        yield keep
    finally:
        _passing.reset(token)
        if (around := _passing.get()) is not None:
            around.extend(stay)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trim_heap() -> None:
    """Give memory that was freed back to the system."""
    with contextlib.suppress(AttributeError, OSError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map function that hands its task's memory back when it ends.

    Python workers outlive their tasks, and a busy executor may hold several idle ones.
    """
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim_heap()

    return wrapped


def map_texts(docs: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over whole texts, at most ``rows`` of them in a batch.

    Spark's 10,000 rows a batch are meant for numbers: as texts they take tens of megabytes on
    both sides of the pipe. The limit is the session's and stays in force until the frame is run.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return docs.mapInArrow(lean(run), schema)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def text_bytes(text: Column | str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(total: int, size: int) -> int:
    """How many blocks of about ``size`` hold ``total``; at least one."""
    return max(1, -(-int(total or 0) // size))

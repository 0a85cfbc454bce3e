"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # "Most recent n" keeps its map-side limit up to this n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # Recording the Python call site of every column costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "fieldobs", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every stored instant is UTC wall-clock time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_timers(spark: SparkSession) -> SparkSession:
    """Keep streaming state in RocksDB, the one store that offers the timers of ``transformWithState``.

    A session that others built has Spark's default, which refuses them. A query takes the setting
    when it starts; one that runs, or starts again from its checkpoint, keeps the store it has.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key) != SETTINGS[key]:
        spark.conf.set(key, SETTINGS[key])
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    The cluster names its shared folder in ``spark.checkpoint.dir``; only a local session
    that leaves it unset (a test) gets a temporary folder, kept for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        base = tempfile.mkdtemp(prefix="fieldobs-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

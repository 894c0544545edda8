"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE re-plans joins and splits hot partitions at run time. Arrow batches are kept small because
# html rows are large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # The JVM does not compile methods over 8000 bytes; wide projections run faster split up than
    # as one generated stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Word sets per ISBN are small; keep hashing them beyond the default of 128 groups per task.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # Tables are read in small parts, as folds sort the rows of a part.
    "spark.sql.files.maxPartitionBytes": "32m",
}

# Those of them that wide projections, word sets and folds need, and that a running session can take on.
RUNTIME = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold",
           "spark.sql.files.maxPartitionBytes")


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> None:
    """Give a session that :func:`configure` did not build the settings in ``RUNTIME``; those it has set itself stay."""
    for key in RUNTIME:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, SETTINGS[key])


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="shopcat-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs.

    A started stream has its own copy of the settings, so the session's are put back.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

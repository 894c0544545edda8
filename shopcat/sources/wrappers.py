"""Selectors of sites as a table in versions: edits are added, never written over."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcat.schemas import WRAPPER_VERSIONS
from shopcat.sources import snapshots

BUCKETS = 8


def publish_wrappers(rows: DataFrame, root: str, valid_from: datetime | None = None) -> None:
    """Add selectors (domain, field, query, attr) that replace all earlier ones of their domains from a time on.

    Without a time they hold from the beginning. A domain's row with a null field ends its selectors. Readers see all
    rows or none; of two writers at once one fails with ``snapshots.Conflict`` and can do it again.
    """
    timed = rows.select("domain", "field", "query", "attr", F.lit(valid_from).cast("timestamp").alias("valid_from"))
    snapshots.append(rows.sparkSession, root, timed, F.col("domain"), buckets=BUCKETS)


def read_wrappers(spark: SparkSession, root: str) -> DataFrame:
    """All selectors published so far with their ``valid_from``, as ``scrape`` takes them."""
    return snapshots.read_version(spark, root, WRAPPER_VERSIONS)

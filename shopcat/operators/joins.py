"""Joins of a large table with a lookup table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a table's rows as text. One aggregate job over ``df``."""
    row = F.to_json(F.struct("*"))
    return df.agg(F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("n")).first()["n"]


def fits_broadcast(lookup: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Is the lookup table, as it would be sent, within ``max_bytes``?"""
    return measured_bytes(lookup) <= max_bytes

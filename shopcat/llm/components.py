"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node that reaches a smaller one, with the smallest it reaches.

    ``links`` has the columns a and b (long), in any order and with repeats. Links from a node to
    itself and links with a null end are ignored. Each round moves
    every node to the smallest neighbour of its neighbour, so the number of rounds grows with the
    logarithm of the longest path. A round is a map-side reduced minimum and a join on node, both
    hash shuffles whose hot keys AQE can split; every round is a written table, so a lost executor
    costs no earlier round. Only a row of two numbers per round reaches the driver.
    """
    ends = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    current, state = written(ends, "links"), None
    while (new := _state(current)) != state:
        state = new
        rounded = written(_small(_large(current)), "links")
        discard(current)
        current = rounded
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    low = _lowest(links).withColumnRenamed("a", "b")
    return links.join(low, "b", "left").select(
        "a", F.coalesce("low", "b").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    low = _lowest(links)
    moved = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()

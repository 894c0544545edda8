"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import stars, written
from shopcat.llm.components import components

PASSES = 20  # sorted orders at least; a pair is missed only if it is far apart in all of them
MISSED = 0.001  # share of pairs at the linking angle that may be far apart in all orders
SAMPLE = 1000  # vectors by which the number of orders is planned
WINDOW = 32  # following neighbours that a vector is compared with in each order
HASHES = 8  # random hashes in a sort key, 7 bits each
RINGS = 64  # rings of the angle to a group's centre that make up the linking angle
BLOCK = 512  # vectors of a ring that are compared as one block
AXES = 64


def _codes(x: np.ndarray, p: int, h: int, seed: int) -> np.ndarray:
    """Hash ``h`` of order ``p``: the nearest of 2 * 64 directions of a random projection (cross-polytope)."""
    axes = np.random.default_rng((seed, p, h, x.shape[1])).standard_normal((x.shape[1], AXES))
    y = x @ axes
    top = np.abs(y).argmax(axis=1)
    return 2 * top + (y[np.arange(len(y)), top] < 0)


def sort_keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """(rows, passes) sort keys: each is ``HASHES`` random hashes, one after the other.

    Vectors with a small angle share a hash more often than as many hyperplane signs.
    """
    keys = np.zeros((len(x), passes), np.int64)
    for p in range(passes):
        for h in range(HASHES):
            keys[:, p] = keys[:, p] * (2 * AXES) + _codes(x, p, h, seed)
    return keys


def planned_passes(x: np.ndarray, rows: int, least: float, window: int, seed: int) -> int:
    """Orders after which a pair of cosine ``least`` is missed with probability ``MISSED``, for ``rows`` vectors like ``x``.

    A pair meets in an order if the rows that share its equal prefix of hashes fit into the window. Each
    vector of the sample gets a partner of that cosine; how often a hash is equal is counted for the partner and
    for the rest of the sample, whose powers give the rows that share longer prefixes. So more rows
    and crowded directions get more orders. The mean is taken over the worst tenth of the sample.
    Vectors that link with a vector themselves don't count: they are in its group.
    """
    x = _unit(x.astype(float))
    if len(x) < 2 or x.shape[1] < 2:
        return PASSES
    side = np.random.default_rng(seed).standard_normal(x.shape)
    side = side - np.einsum("ij,ij->i", side, x)[:, None] * x
    partner = least * x + math.sqrt(max(0.0, 1 - least * least)) * _unit(side)
    same, met, tries = np.zeros((len(x), len(x)), np.float32), np.zeros(len(x)), PASSES * HASHES
    for p in range(PASSES):
        for h in range(HASHES):
            own = _codes(x, p, h, seed)
            same += own[:, None] == own
            met += own == _codes(partner, p, h, seed)
    equal, met = same / tries, np.maximum(met, 1) / tries
    equal[x @ x.T >= least] = 0
    meets = np.zeros(len(x))
    for k in range(1, HASHES + 1):
        between = rows * (equal ** k).mean(axis=1)
        exactly = met ** k * (1 - met if k < HASHES else 1)
        meets += exactly * np.minimum(1, window / np.maximum(between, 1e-9))
    meets = np.sort(np.minimum(meets, 1 - 1e-9))[: max(1, len(x) // 10)]
    passes = PASSES
    while ((1 - meets) ** passes).mean() > MISSED:
        passes = math.ceil(passes * 1.1)
    return passes


def _planned(classes: DataFrame, least: float, window: int, seed: int) -> int:
    """The most orders that any vector length needs."""
    passes = PASSES
    for row in classes.groupBy("dim").count().collect():
        sample = classes.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()
        x = np.array([r["vector"] for r in sample], float)
        passes = max(passes, planned_passes(x, row["count"], least, window, seed))
    return passes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(passes: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                keys = sort_keys(_unit(np.stack(own["vector"].to_numpy()).astype(float)), passes, seed)
                for p in range(passes):
                    yield pd.DataFrame({"pass": p, "dim": dim, "key": keys[:, p],
                                        "id": own["id"].to_numpy(), "vector": own["vector"].to_numpy()})
    return run


def _window(least: float, window: int, border: bool):
    """Links within ``window`` rows of an order, as stars; with ``border`` also the rows at either
    end of the partition, which the next partition's rows are compared with in a second step."""

    def compare(rows: pd.DataFrame, old: int) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby(["pass", "dim"], sort=False):
            x = _unit(np.stack(own["vector"].to_numpy()).astype(float))
            ids, at = own["id"].to_numpy(), own["at"].to_numpy()
            for s in range(1, min(window, len(own) - 1) + 1):
                # Rows before ``old`` were compared with each other already.
                first = max(0, np.searchsorted(at, old) - s)
                near = np.einsum("ij,ij->i", x[first: len(x) - s], x[first + s:]) >= least
                near = np.flatnonzero(near) + first
                found.append((ids[near], ids[near + s]))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else ([], [])
        a, b = stars(a, b) if len(a) else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, count, tail = None, 0, None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.assign(at=np.arange(count, count + len(frame)))
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            yield compare(rows, count)
            if border and count < window:
                yield frame[frame["at"] < window].assign(border=True)
            count, rest = count + len(frame), rows.tail(window)
        if border and rest is not None:
            yield rest[rest["at"] >= window].assign(border=True)

    def once(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "at"], ignore_index=True)
        return compare(frame.assign(at=np.arange(len(frame))), 0)

    def shaped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "b", "pass", "dim", "part", "at", "id", "vector"]
        for frame in run(frames):
            shaped_frame = frame.reindex(columns=names)
            if "vector" not in frame:
                shaped_frame["vector"] = None
            yield shaped_frame

    return shaped if border else once


def links(classes: DataFrame, least: float, passes: int, window: int, seed: int) -> DataFrame:
    """(a, b): links found between distinct vectors (id, dim, vector), enough to connect all groups.

    All passes run in one job: one range shuffle by (pass, key) sorts them, tasks slide a window over
    their rows, and the rows at partition ends are compared again in a second, small step.
    """
    kind = dict(classes.dtypes)["vector"]
    order = ["pass", "dim", "key", "id"]
    entries = classes.mapInPandas(
        _entries(passes, seed), f"pass int, dim int, key long, id long, vector {kind}")
    sorted_rows = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id())
    seen = written(sorted_rows.mapInPandas(
        _window(least, window, True),
        f"a long, b long, pass int, dim int, part int, at long, id long, vector {kind}"), "windows")
    inside = seen.where("a IS NOT NULL").select("a", "b")
    # Per order, as many rows as partitions have ends: this grows with the cluster, not the data.
    across = seen.where("a IS NULL").groupBy("pass", "dim").applyInPandas(
        _window(least, window, False), "a long, b long")
    return inside.union(across)


def _usable(vector: Column) -> Column:
    """Is it a vector with an angle: finite throughout and not zero?"""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _link_counts(members: DataFrame, least: float) -> DataFrame:
    """(id, linked): exact number of rows in the same group that each distinct vector links with.

    ``members`` has id, copies, vector, component. The window has a bound, so counts are completed
    here. With angles to the group's centre, two vectors whose angles add up to less than the
    linking angle are linked for certain; these are counted by rings, without pairs. Only pairs of
    blocks of rings where this doesn't decide are compared, as matrix products.
    """
    limit = math.acos(least)
    unit = members.withColumn("_n", _norm(F.col("vector"))).withColumn(
        "unit", F.transform("vector", lambda x: x.cast("double") / F.col("_n")))
    centre = (
        unit.select("component", F.posexplode("unit").alias("k", "x"))
        .groupBy("component", "k").agg(F.sum("x").alias("x"))
        .groupBy("component").agg(F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("centre"))
        .withColumn("_c", _norm(F.col("centre")))
    )
    dot = F.aggregate(F.zip_with("unit", "centre", lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.greatest("_c", F.lit(1e-300))))) + 1e-6
    ringed = written(
        unit.join(centre, "component").withColumn("ring", F.floor(angle / (limit / RINGS)).cast("int"))
        .select("id", "copies", "component", "ring", "vector"), "rings")
    rings = ringed.groupBy("component", "ring").agg(
        F.sum("copies").alias("rows"), F.count("*").alias("vectors"))
    by_group = rings.groupBy("component").agg(
        F.collect_list(F.struct("ring", "rows")).alias("rings"))  # at most RINGS * pi / limit
    last = RINGS - 2
    sure = ringed.join(by_group, "component").select(
        "id", (F.aggregate(
            F.filter("rings", lambda r: r["ring"] + F.col("ring") <= last), F.lit(0).cast("long"),
            lambda s, r: s + r["rows"],
        ) - F.when(2 * F.col("ring") <= last, F.col("copies")).otherwise(0)).alias("linked"))

    blocks = rings.withColumn("salts", F.ceil(F.col("vectors") / BLOCK).cast("int"))
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    one = salted.select("component", F.col("ring").alias("r1"), F.col("salt").alias("s1"))
    two = salted.select("component", F.col("ring").alias("r2"), F.col("salt").alias("s2"))
    pairs = one.join(two, "component").where(
        (F.col("r1") + F.col("r2") > last) & (F.abs(F.col("r1") - F.col("r2")) <= RINGS + 1)
        & (F.struct("r1", "s1") <= F.struct("r2", "s2")))
    sides = pairs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("side")).where(
        "side = 1 OR r1 <> r2 OR s1 <> s2").select(
        "component", "r1", "s1", "r2", "s2", "side",
        F.when(F.col("side") == 1, F.col("r1")).otherwise(F.col("r2")).alias("ring"),
        F.when(F.col("side") == 1, F.col("s1")).otherwise(F.col("s2")).alias("salt"))
    placed = ringed.join(blocks.select("component", "ring", "salts"), ["component", "ring"]).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(frame["vector"].to_numpy()).astype(float))
        left = (frame["side"] == 1).to_numpy()
        weight, ids = frame["copies"].to_numpy(), frame["id"].to_numpy()
        if left.all():
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            return pd.DataFrame({"id": ids, "linked": near @ weight})
        near = x[left] @ x[~left].T >= least
        return pd.DataFrame({"id": np.concatenate([ids[left], ids[~left]]),
                             "linked": np.concatenate([near @ weight[~left], near.T @ weight[left]])})

    unsure = placed.join(sides, ["component", "ring", "salt"]).select(
        "component", "r1", "s1", "r2", "s2", "side", "id", "copies", "vector",
    ).groupBy("component", "r1", "s1", "r2", "s2").applyInPandas(count, "id long, linked long")
    return sure.union(unsure).groupBy("id").agg(F.sum("linked").alias("linked"))


def near_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
    passes: int | None = None, window: int = WINDOW, seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept): groups of vectors with cosine >= ``least``.

    Vectors are compared in double precision. In each of ``passes`` orders by random keys, a vector
    is compared with ``window`` neighbours; verified pairs are united across orders. Without
    ``passes``, their number follows the rows and their density (:func:`planned_passes`). Equal vectors
    are one node. Within the groups found, link counts are exact.

    Null, zero or non-finite vectors and rows with a null id link with nothing; vectors of
    different lengths do not link. Repeated rows count as rows of their own. An empty table gives
    an empty result.
    """
    vector = F.col(vector_col)
    base = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).withColumn(
        "ok", _usable(F.col("vector")) & F.col("id").isNotNull())
    # Two different vectors with one 128-bit key are not a practical case; the key is for the shuffle.
    keyed = base.withColumn("class", F.when(F.col("ok"), F.md5(
        F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))))
    classes = written(
        keyed.where("ok").groupBy("class").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector")), "classes")
    if passes is None:
        passes = _planned(classes, least, window, seed)
    groups = written(components(links(
        classes.select("id", "dim", "vector"), least, passes, window, seed)), "groups")
    grouped = groups.select(F.col("component").alias("id"), "component").distinct().union(
        groups.select(F.col("node").alias("id"), "component"))
    members = classes.join(grouped, "id").select("id", "copies", "component", "vector")
    counts = _link_counts(members, least)
    named = classes.select("class", "id", "copies").join(grouped, "id", "left").join(counts, "id", "left").select(
        "class", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return (
        keyed.select("id", "ok", "class").join(named, "class", "left").select(
            "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )

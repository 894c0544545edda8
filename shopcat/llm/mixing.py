"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcat.llm.common import WORD, written

MOST = 3  # copies of a document at most
ROUNDS, CLOSE = 100, 1e-9  # Newton steps at most; relative error of every target at which they stop
BUCKET = 256  # documents of one size and source that one window ranks


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """Add ``target`` to a table of one row per source (source, size).

    Sources by code point, null last, get the weights in turn. They share the sum of all sizes; a
    target stops at ``most`` times its source's size, and the excess goes to the others by weight. The
    windows run over one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    # Sources fill up in order of limit per weight. Two running sums give the level that a source and all
    # after it would share; the first source that does not fill up at its own level sets the level.
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shared = (
        ranked.withColumn("limit", F.lit(float(most)) * F.col("size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("first", F.min(F.when(F.col("level") < F.col("ratio"), F.struct(
            "ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everything))
        .withColumn("full", F.coalesce(F.col("ratio") < F.col("first.ratio"), F.lit(True)))
    )
    return shared.select("source", "size", F.when(F.col("full"), F.col("limit")).otherwise(
        F.col("first.level") * F.col("weight")).alias("target"))


def tilts(cells: DataFrame, targets: list[tuple[str, DataFrame]]) -> DataFrame:
    """Solve the entropy balance of ``cells`` (key columns, size) for several sets of targets.

    ``targets`` has (column, table of that column and target) pairs; together they constrain
    sum(size * exp(tilt)) over the cells of each key. The tilt of a cell is the sum of its keys'
    multipliers, which minimize the convex dual sum(size * exp(tilt)) - sum(multiplier * target).
    Each Newton step is one Spark job that reduces the cells to the gradient and the nonzero entries of
    the Hessian: as many numbers as pairs of constraints that share cells, whatever the documents.
    Steps are halved until the dual falls. Keys with target 0 or size 0 have rate 0 (tilt null).

    Returns the cells with ``rate``. Null keys are keys.
    """
    spark = cells.sparkSession
    numbered, goals = cells, []
    for k, (column, table) in enumerate(targets):
        rows = table.select(column, "target").where("target > 0").orderBy(column).collect()  # one per constraint
        keys = spark.createDataFrame(
            [(r[0], len(goals) + i) for i, r in enumerate(rows)], f"key {dict(cells.dtypes)[column]}, k{k} int")
        numbered = numbered.join(F.broadcast(keys), numbered[column].eqNullSafe(keys["key"]), "left").drop("key")
        goals += [float(r["target"]) for r in rows]
    ks = [f"k{k}" for k in range(len(targets))]
    numbered = written(numbered, "cells")
    free = numbered.where("size > 0").dropna(subset=ks)
    goal, x = np.array(goals), np.zeros(len(goals))

    def rated(df: DataFrame, values: np.ndarray) -> DataFrame:
        table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, multiplier double")
        tilt = F.lit(0.0)
        for k in ks:
            df = df.join(F.broadcast(table.select(F.col("k").alias(k), F.col("multiplier").alias(f"_{k}"))), k, "left")
            tilt = tilt + F.col(f"_{k}")
        return df.withColumn("rate", F.exp(tilt)).drop(*[f"_{k}" for k in ks])

    def reduced(values: np.ndarray) -> tuple[float, np.ndarray, list]:
        """The dual, its gradient and the Hessian's entries (i, j, value)."""
        pairs = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a in ks for b in ks])
        entries = rated(free, values).select(F.explode(pairs).alias("p"), (F.col("size") * F.col("rate")).alias("m")).groupBy(
            "p.i", "p.j").agg(F.sum("m").alias("m")).collect()
        mass = np.zeros(len(goal))
        for e in entries:
            if e["i"] == e["j"]:
                mass[e["i"]] = e["m"]
        return mass.sum() / len(ks) - values @ goal, mass - goal, entries

    def step(slope: np.ndarray, entries: list) -> np.ndarray:
        diagonal = np.zeros(len(goal))
        for e in entries:
            if e["i"] == e["j"]:
                diagonal[e["i"]] = e["m"]
        if len(ks) == 1:
            return slope / np.where(diagonal > 0, diagonal, 1)
        hessian = np.zeros((len(goal), len(goal)))
        for e in entries:
            hessian[e["i"], e["j"]] = e["m"]
        return np.linalg.lstsq(hessian, slope, rcond=None)[0]

    if len(goal):
        value, slope, entries = reduced(x)
        for _ in range(ROUNDS):
            if np.all(np.abs(slope) <= CLOSE * goal):
                break
            move, scale = step(slope, entries), 1.0
            tried = reduced(x - move)
            while tried[0] > value + 1e-12 * abs(value) and scale > 1e-6:
                scale /= 2
                tried = reduced(x - scale * move)
            x, (value, slope, entries) = x - scale * move, tried
    return rated(numbered, x).withColumn("rate", F.coalesce("rate", F.lit(0.0))).drop(*ks)


def document_rates(classes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``rate`` to ``classes`` (source, size, n): the entropy balance of documents under a word target per source.

    Of all rates up to ``most`` whose words sum to the source's target, those nearest to 1 in entropy are
    min(most, exp(multiplier * size)): a document is tilted by its own size. The multipliers are the zeros of the dual's
    gradient. Each Newton step is one Spark job that reduces the classes, which are far fewer than documents, to a gradient
    and a curvature for each source; multipliers stay a table and never come to the driver. Sizes are whole
    numbers, so a multiplier lies between -log(source / target) and log(most); a step that leaves the
    interval known so far halves it instead. Sums are decimals, so the order of rows does not matter. A source stops once its
    gradient is below :data:`CLOSE` of its target.

    A source whose target is all it can give has the rate ``most``. Documents without words have rate 1. Null sources
    are a source.
    """
    words = F.col("size").cast("double")
    ratio = F.col("target") / words
    state = written(targets.where("size > 0").select(
        F.struct("source").alias("key"), "target", F.when(ratio < most - 1e-9, F.lit(False)).otherwise(True).alias("done"),
        F.when(ratio < most - 1e-9, F.lit(0.0)).otherwise(F.lit(math.log(most))).alias("x"),
        F.least(F.log(ratio), F.lit(0.0)).alias("low"),
        F.when(ratio > 1, F.lit(math.log(most))).otherwise(0.0).alias("high")), "multipliers")
    keyed = classes.where("size > 0").withColumn("key", F.struct("source"))
    small = targets.count() <= 100_000

    def meet(rows: DataFrame, multipliers: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(multipliers) if small else multipliers, "key")

    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    tilted = F.exp(F.least(F.col("x") * F.col("size"), F.lit(math.log(most))))
    free = F.col("x") * F.col("size") < math.log(most)
    for _ in range(ROUNDS):
        reduced = meet(keyed, state.where("NOT done").select("key", "x")).withColumn("words", F.col("n") * F.col("size") * tilted).groupBy(
            "key").agg(exact(F.col("words")).alias("given"),
                       exact(F.when(free, F.col("words") * F.col("size")).otherwise(0)).alias("curve"))
        slope = F.col("given") - F.col("target")
        low = F.when(slope < 0, F.col("x")).otherwise(F.col("low"))
        high = F.when(slope > 0, F.col("x")).otherwise(F.col("high"))
        newton = F.col("x") - slope / F.nullif(F.col("curve"), F.lit(0.0))
        inside = (newton > low) & (newton < high)
        close = F.abs(slope) <= CLOSE * F.col("target")
        moved = F.when(close, F.col("x")).when(inside, newton).otherwise((low + high) / 2)
        state = written(state.join(reduced, "key", "left").select(
            "key", "target", (F.col("done") | close).alias("done"),
            F.when(F.col("done"), F.col("x")).otherwise(moved).alias("x"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high")), "multipliers")
        if state.where("NOT done").isEmpty():
            break
    given = targets.select(F.struct("source").alias("key"), (F.col("target") >= (most - 1e-9) * words).alias("full"))
    rated = meet(meet(classes.withColumn("key", F.struct("source")), given).where("size > 0"), state.select("key", "x"))
    none = classes.where("size = 0").select("source", "size", "n", F.lit(1.0).alias("rate"))
    return rated.select("source", "size", "n", F.when(F.col("full"), F.lit(float(most))).otherwise(tilted).alias("rate")).union(none)


def copies(docs: DataFrame, rates: DataFrame, most: int = MOST) -> DataFrame:
    """(id, source, size, copies): round the rates of documents into copies.

    ``docs`` has id, source, size; ``rates`` has source, size, their number n, and rate. Every document has the whole part of
    its rate. The rest is dealt to documents by falling size: the documents of one size get as many more copies as
    bring the source's words nearest to those due so far, so the words of a source end within half a
    small document of its target. This fold reads one row per source and size. Which documents of a size get one
    is decided by a hash of the id, ranked in buckets of bounded size; so reruns agree.
    """

    def fold(frame):
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        owed, wholes, extra = 0.0, [], []
        for size, n, rate in zip(frame["size"], frame["n"], frame["rate"]):
            whole = int(rate + 1e-9)
            owed += max(0.0, rate - whole) * size * n
            more = int(min(n, max(0, round(owed / size)))) if size and whole < most else 0
            owed -= more * size
            wholes.append(whole)
            extra.append(more)
        return frame.assign(whole=wholes, extra=extra)[["source", "size", "n", "whole", "extra"]]

    plan = written(rates.groupBy("source").applyInPandas(
        fold, "source string, size long, n long, whole long, extra long"), "plan")
    key = F.struct("source", "size")
    ranked = docs.withColumn("key", key).join(
        plan.select(key.alias("key"), "n", "whole", "extra"), "key").withColumn(
        "hash", F.xxhash64("id", "source")).withColumn(
        "bucket", F.pmod(F.col("hash"), F.ceil(F.col("n") / BUCKET)))
    # Buckets of one size share its extra copies in turn, by running numbers of documents.
    sizes = ranked.groupBy("key", "bucket").agg(F.count("*").alias("own"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    running = Window.partitionBy("key").orderBy("bucket")
    through = F.sum("own").over(running)
    share = lambda c: F.floor(c * F.col("extra") / F.col("n"))
    quotas = sizes.withColumn("through", through).select(
        "key", "bucket", (share(F.col("through")) - share(F.col("through") - F.col("own"))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash", "id"))
    dealt = ranked.join(quotas, ["key", "bucket"]).withColumn("place", place)
    return dealt.select("id", "source", "size", (
        F.col("whole") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)).cast("long").alias("copies"))


def balanced(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies): mix ``docs`` (id, source, size) by weight.

    Token targets per source come from :func:`weighted_targets`, rates of documents from the Newton solution of
    :func:`document_rates`, whole numbers from :func:`copies`. Documents without words have one copy. An empty table gives
    an empty result.
    """
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    targets = written(weighted_targets(sizes, weights, most), "targets")
    classes = written(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    dealt = copies(docs, document_rates(classes, targets, most), most)
    named = targets.select(F.struct("source").alias("key"), F.col("size").alias("source_size"), "target")
    return dealt.join(F.broadcast(named) if named.count() <= 100_000 else named,
                      F.struct(dealt["source"]) == named["key"]).select(
        "id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """The mixture: each row of ``docs`` (doc_id, text, source and others) as often as it has copies.

    Copies are decided on ids and sizes; texts move once, to meet them. Repeated rows are one row with
    the copies of all.
    """
    key = F.struct("doc_id", F.xxhash64("text", "source"))
    sizes = written(docs.select(key.alias("id"), "source", size_of(F.col("text")).alias("size")), "sizes")
    dealt = written(balanced(sizes, weights, most).groupBy(F.col("id").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "copies")
    met = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row")).join(dealt.where("_copies > 0"), "_key")
    if not dealt.where("_rows > 1").isEmpty():
        met = met.dropDuplicates(["_key"])
    return met.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")

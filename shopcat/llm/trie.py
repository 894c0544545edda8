"""Prefix trie of conversations: whole sequences are collapsed first, then prefixes of the distinct ones are weighed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcat.llm.common import discard, written

HEAD = 8  # most turns that a rebuilt conversation takes from another
FAMILY = 5  # conversations that may start with the turns of the same one
BLOCK = 256  # turns of a conversation whose running values one task computes
IDS = 1 << 16  # conversation ids of one row of an end list

KEY = ["depth", "k1", "k2"]  # a node: its depth and 128 bits over its turns


def _lane(digest: Column, place: int) -> Column:
    """64 of a hexadecimal digest's bits as a long."""
    high = F.conv(F.substring(digest, place, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, place + 8, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Digests of turns in order, and where each conversation's turns stand in them.

    ``rows(conv, _at, _part, digest, size)`` is a written table sorted by conversation, turn (null first), role and
    text; ``parts(conv, _part, shift, turns)`` has one row per conversation and partition: a turn's number within
    its conversation, from 1, is ``_at + shift``, and ``turns`` is the length of the conversation. The range shuffle
    splits a conversation of any length. Texts are moved once.
    """
    clean = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # The length in front tells where the role ends.
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = written(
        clean.repartitionByRange(*order, F.xxhash64("text")).sortWithinPartitions(*order).select(
            "conv", F.monotonically_increasing_id().alias("_at"), digest.alias("digest"),
            F.octet_length("text").cast("long").alias("size")), "turns").withColumn("_part", F.shiftright("_at", 33))
    own = rows.groupBy("conv", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    all_parts = Window.partitionBy("conv")
    earlier = all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.select(
        "conv", "_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"),
        F.sum("n").over(all_parts).alias("turns"))
    return rows, parts


def rebuilt(rows: DataFrame, parts: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv), their rebuilt turns (conv, depth, k1, k2, size)).

    Conversation c takes the first h turns of conversation c - c % ``family``, then its own after its
    first h, with h = crc32 of c in decimal, unsigned, modulo ``head`` + 1. ``k1`` and ``k2`` are 128 bits
    of a SHA-256 of the turn and its depth.
    """
    lengths = written(parts.select("conv", "turns").distinct(), "lengths")
    base = lengths.select(F.col("conv").alias("base"), F.least("turns", F.lit(head)).alias("has"))
    plan = lengths.select(
        "conv", (F.col("conv") - F.col("conv") % family).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % (head + 1)).alias("h"),
    ).join(base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    # One row per conversation and partition, so that a long conversation is never one key of this join.
    placed = rows.join(parts.join(plan, "conv"), ["conv", "_part"]).withColumn("place", F.col("_at") + F.col("shift"))
    own = placed.where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "size")
    heads = placed.where((F.col("place") <= head) & (F.col("conv") == F.col("base"))).groupBy("base").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("head"))  # at most ``head`` turns
    taken = plan.where("taken > 0").join(heads, "base").select(
        "conv", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t")
    ).select("conv", F.col("t.place").alias("depth"), "t.digest", "t.size")
    placed_digest = F.sha2(F.concat_ws(":", "depth", "digest").cast("binary"), 256)
    turns = own.unionByName(taken).withColumn("_d", placed_digest).select(
        "conv", "depth", _lane(F.col("_d"), 1).alias("k1"), _lane(F.col("_d"), 17).alias("k2"), "size")
    return lengths.select("conv"), written(turns, "rebuilt")


def prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """All prefixes, the empty one too, of the sequences' representatives: (rep, depth, k1, k2, p1, p2, size, before).

    A prefix's key is the exclusive or of its turns' keys, which hold their depth; (p1, p2) is the parent's. ``before``
    counts the bytes of the turns above. Running values are taken in blocks, then within a block.
    """
    mine = turns.join(sequences.select(F.col("rep").alias("conv")), "conv", "left_semi").withColumn(
        "block", F.floor((F.col("depth") - 1) / BLOCK))
    blocks = mine.groupBy("conv", "block").agg(
        F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("size").alias("bytes"))
    above = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.bit_xor("b1").over(above), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("b2").over(above), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("bytes").over(above), F.lit(0)).alias("bytes"))
    run = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = mine.join(blocks, ["conv", "block"]).select(
        F.col("conv").alias("rep"), "depth", "size", F.col("k1").alias("t1"), F.col("k2").alias("t2"),
        F.bit_xor("k1").over(run).bitwiseXOR(F.col("b1")).alias("k1"),
        F.bit_xor("k2").over(run).bitwiseXOR(F.col("b2")).alias("k2"),
        (F.sum("size").over(run) + F.col("bytes") - F.col("size")).alias("before"))
    inner = inner.select(
        "rep", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "size", "before")
    zero = F.lit(0).cast("long")
    roots = sequences.select(
        "rep", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"),
        zero.alias("size"), zero.alias("before"))
    return inner.select(roots.columns).unionByName(roots)


def end_digests(whole: DataFrame, ids: int = IDS) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ascending ids of the conversations of each sequence.

    The ids are sorted by a range shuffle, which splits a sequence with any number of copies, and joined to texts of
    up to ``ids`` ids. Only these texts meet by sequence, sorted, where they stream through the digest.
    """
    kind = ", ".join(f"{k} long" for k in KEY)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in KEY]))
            convs, at, out = batch.column("conv").to_pylist(), 0, []
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and stop - at < ids and keys[stop] == keys[at]:
                    stop += 1
                out.append((*keys[at], convs[at], ",".join(map(str, convs[at:stop]))))
                at = stop
            if out:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[:4]] + [pa.array([o[4] for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], pa.int64()) for k in key], pa.array([sha.hexdigest()])], [*KEY, "ends_sha256"])

        key = sha = None
        for batch in batches:
            out = []
            for *at, part in zip(*[batch.column(k).to_pylist() for k in [*KEY, "ids"]]):
                if tuple(at) == key:
                    sha.update(b"," + part.encode())
                    continue
                if key is not None:
                    out.append(done(key, sha))
                key, sha = tuple(at), hashlib.sha256(part.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not None:
            yield done(key, sha)

    order = [*KEY, "conv"]
    listed = whole.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        texts, f"{kind}, first long, ids string")
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{kind}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node, from the root without a turn.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members: the conversations
    that start with the node's turns), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over
    the subtree, each node's members but one times the UTF-8 bytes of its last text) and ends_sha256 (of the ids of the
    conversations that end at the node, ascending, joined by commas). Subtrees include their top. How conversations are
    rebuilt says :func:`rebuilt`; ``head=0`` leaves them as they are.

    Equal rebuilt conversations are collapsed into one weighted sequence first, so copies are never spread into turns.
    A sequence that is a proper prefix of another is found by an anti-join of whole keys with proper
    prefixes; the others are the leaves. Prefixes of distinct sequences are then summed by key. The saved bytes of a
    subtree need no pairs of nodes: with T(s) the bytes of a sequence s through a node, they are the sum of
    weight(s) * (T(s) - bytes above) less the bytes of the subtree's distinct nodes. Each
    distinct node is counted with the sequence that has its smallest member; those nodes are a suffix of that sequence.

    Turns are ordered by turn (null first), then by role and text; repeated rows are repeated turns. A null role or text is
    empty. Rows without a conversation id are left out. An empty table has no node. Other columns are not read. Keys
    have 128 bits.
    """
    rows, parts = numbered(turns, conv, turn, role, text)
    convs, moved = rebuilt(rows, parts, family, head)
    zero = F.lit(0).cast("long")
    sums = moved.groupBy("conv").agg(
        F.count("*").alias("depth"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("size").alias("total"))
    whole = written(convs.join(sums, "conv", "left").select(
        "conv", *[F.coalesce(c, zero).alias(c) for c in [*KEY, "total"]]), "whole")
    sequences = written(whole.groupBy(*KEY).agg(
        F.count("*").alias("weight"), F.min("conv").alias("rep"), F.min("total").alias("total")), "sequences")
    paths = written(prefixes(moved, sequences), "prefixes")

    length = sequences.select("rep", F.col("depth").alias("length"))
    inner = paths.join(length, "rep").where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    # The node's smallest member owns it; above ``own`` bytes its nodes belong to other sequences.
    owners = paths.groupBy(*KEY).agg(F.min("rep").alias("rep"), F.min("before").alias("before"))
    own = owners.groupBy("rep").agg(F.min("before").alias("own"))
    facts = sequences.select("rep", "weight", "total").join(leaves, "rep", "left").join(own, "rep", "left").select(
        "rep", "weight", "total", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("own", "total").alias("own"))
    nodes = written(paths.join(facts, "rep").groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "own"))).alias("saved_tokens")),
        "nodes")
    for table in (rows, convs, moved, sequences, paths):
        discard(table)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(whole)
    return nodes.join(children, KEY, "left").join(ends, KEY, "left").join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

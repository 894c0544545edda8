"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import stars, written
from shopcat.llm.components import components

BITS, SEGMENTS, WIDTH, DISTANCE = 64, 8, 8, 3
FEW = 9  # bits that no key has used yet, at which a bucket has 2 ** 9 fingerprints at most
BUCKET = 512  # fingerprints compared under one key; larger buckets are split by further bits
FULL = (1 << BITS) - 1


def simhash(text: str | None, n: int = 3, seed: int = 42) -> int:
    """Bitwise majority of the XXH64 of the text's n-word shingles, repeats counted; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - n + 1)
    spans = zip(starts[:count].tolist(), ends[min(n, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at: at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fingerprint long). One pass over the whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), n) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fingerprint long")


def _ring(start: int, length: int) -> int:
    """Mask of ``length`` segments from ``start`` around the ring."""
    mask = 0
    for k in range(length):
        mask |= ((1 << WIDTH) - 1) << (WIDTH * ((start + k) % SEGMENTS))
    return mask


def _budgets(start: int) -> list[tuple[int, int]]:
    """(mask, most differing bits) of each prefix of the chain that starts at ``start``."""
    return [(_ring(start, k), k * DISTANCE // SEGMENTS) for k in range(1, SEGMENTS + 1)]


def _halves(mask: int, parts: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    size = -(-len(bits) // parts)
    return [sum(1 << b for b in bits[k: k + size]) for k in range(0, len(bits), size)]


def first_masks() -> list[tuple[int, int]]:
    """(chain start, mask) of the keys under which every pair within the distance meets.

    The strong pigeonring principle: some chain keeps every prefix of k segments within
    k * 3 / 8 differing bits. So its first two segments are equal, and the next three differ by at
    most one bit; then one half of these three is equal too. A key is the two segments and a half.
    """
    out = []
    for start in range(SEGMENTS):
        exact, loose = _ring(start, 2), _ring(start, 5) & ~_ring(start, 2)
        out += [(start, exact | half) for half in _halves(loose, 2)]
    return out


def refined(mask: int) -> list[int]:
    """Masks with more bits: a pair that is equal under ``mask`` is equal under one of these."""
    return [mask | part for part in _halves(FULL & ~mask, DISTANCE + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _keys(masks: list[tuple[int, int]]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(start).alias("start"), F.lit(_signed(mask)).alias("mask"),
            F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("bits"),
        ) for start, mask in masks
    ])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows that are sorted by (start, mask, bits), as stars within each batch."""
    chains = {s: [(np.uint64(m), d) for m, d in _budgets(s)] for s in range(SEGMENTS)}
    rest = None
    for batch in _ended(batches):
        if batch is None:
            part, rest = rest, None
        else:
            cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(4)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            part, rest = [c[~same] for c in cols], [c[same] for c in cols]
        if part is None or len(part[0]) < 2:
            continue
        start, mask, bits, prints = part
        prints = prints.view(np.uint64)
        at, shift, found = np.arange(len(start)), 0, []
        while True:
            shift += 1
            at = at[at + shift < len(start)]
            to = at + shift
            at = at[(start[at] == start[to]) & (mask[at] == mask[to]) & (bits[at] == bits[to])]
            if not len(at):
                break
            differ, near = prints[at] ^ prints[at + shift], np.zeros(len(at), bool)
            for s in np.unique(start[at]):
                own = np.flatnonzero(start[at] == s)
                for m, most in chains[int(s)]:  # longer and longer chains; the last is all 64 bits
                    own = own[np.bitwise_count(differ[own] & m) <= most]
                near[own] = True
            found.append((prints[at[near]], prints[at[near] + shift]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if len(a):
            a, b = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within 3 differing bits.

    ``prints`` has one row per distinct ``fingerprint``. Keys come from :func:`first_masks`; a key
    with over ``BUCKET`` fingerprints is split by further bits, level by level, so that no task
    compares an unbounded bucket and no pair is lost. Under a key, a pair must keep each prefix of
    its chain within the budget before all 64 bits are counted.
    """
    entries = prints.select("fingerprint", F.explode(_keys(first_masks())).alias("k")).select(
        "k.start", "k.mask", "k.bits", "fingerprint")
    masks, found = first_masks(), None
    while True:
        sizes = entries.groupBy("start", "mask", "bits").agg(F.count("*").alias("size"))
        large = written(sizes.where(F.col("size") > BUCKET).drop("size"), "large")
        # With few bits left, a bucket can't hold many different fingerprints.
        done = min((FULL & ~m).bit_count() for _, m in masks) <= FEW or large.isEmpty()
        key = ["start", "mask", "bits"]
        small = entries if done else entries.join(large, key, "left_anti")
        pairs = small.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "a long, b long")
        found = pairs if found is None else found.union(pairs)
        if done:
            return found
        finer = {(s, m): refined(m) for s, m in masks}
        masks = [(s, c) for (s, _), more in finer.items() for c in more]
        choices = entries.sparkSession.createDataFrame(  # a few rows for each mask
            [(s, _signed(m), _signed(c)) for (s, m), more in finer.items() for c in more], "start int, mask long, finer long")
        entries = written(
            entries.join(large, key, "left_semi").join(F.broadcast(choices), ["start", "mask"])
            .select("start", F.col("finer").alias("mask"), "fingerprint")
            .withColumn("bits", F.col("fingerprint").bitwiseAND(F.col("mask")))
            .select("start", "mask", "bits", "fingerprint"), "finer")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id): near-duplicate groups of documents.

    Null texts are empty, and texts without words have fingerprint 0 and link like any other. Equal
    fingerprints are one node, whatever their number, so copies are never paired. ``component_id`` is
    the smallest id of the group; documents with a null id belong to their group but never name it
    (null where a group has no other). Repeated rows give repeated rows.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = written(rows.groupBy("fingerprint").agg(F.min("id").alias("lowest")), "prints")
    groups = components(links(prints.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    named = prints.join(groups, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))
    smallest = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_print = named.join(smallest, "component").select("fingerprint", "component_id")
    return rows.join(by_print, "fingerprint").select("id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the row with the smallest ``doc_id``.

    Of rows that repeat this id one stays; of a group whose ids are all null, one row stays. All columns are kept,
    whatever their names.
    """
    groups = near_duplicates(docs)
    keep = groups.where(F.col("id") == F.col("component_id")).select("id").distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["id"], "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    lost = groups.where("component_id IS NULL").select("fingerprint").distinct()
    key = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    prints = nameless.withColumn(key, F.xxhash64("text")).dropDuplicates([key])
    own = fingerprints(prints, key).join(lost, "fingerprint", "left_semi")
    one = components_of_nameless(own).withColumnRenamed("_hash", key)
    return kept.unionByName(prints.join(one, key, "left_semi").drop(key))


def components_of_nameless(own: DataFrame) -> DataFrame:
    """(_hash): one row for each near-duplicate group among rows without an id."""
    own = written(own, "nameless")
    groups = components(links(own.select("fingerprint").distinct()))
    named = own.join(groups, own["fingerprint"] == groups["node"], "left")
    return named.groupBy(F.coalesce("component", "fingerprint")).agg(F.min("id").alias("_hash")).select("_hash")

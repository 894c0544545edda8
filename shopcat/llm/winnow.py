"""Document fingerprints by winnowing, in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcat.llm.common import let, written

GRAM, WINDOW = 5, 4  # words of a gram, grams of a window: any 8 equal words share a fingerprint
PIECE = 16  # a longer run of characters counts as several words
SPAN = 4096  # ids of one bucket of neighbours
HOSTS = 1_000_000  # buckets (16 bytes each) up to which their table is broadcast; beyond it is shuffled


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))


def _turn(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _rolled(hashes: Column, k: int) -> Column:
    """Cyclic-polynomial hash of every k consecutive word hashes; of all of them, if fewer.

    The hash of a gram follows from that of the gram before by one turn and two exclusive ors.
    """

    def gram(at: Column, size: int) -> Column:
        out = F.get(hashes, at)
        for j in range(1, size):
            out = _turn(out, 1).bitwiseXOR(F.get(hashes, at + j))
        return out

    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: _turn(s, 1).bitwiseXOR(h))
    return (
        F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
        .when(F.size(hashes) < k, F.array(whole))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: gram(i, k)))
    )


def _chosen(grams: Column, w: int) -> Column:
    """Positions of the rightmost minimum of each window of w grams (of all, if fewer).

    A gram is one if it is not above the ``left`` grams before it, is below the ``right`` grams after
    it, and a window fits between: left + right + 1 >= w.
    """

    def run(at: Column, step: int) -> Column:
        own, n = F.get(grams, at), F.lit(w - 1)
        for j in range(w - 1, 0, -1):
            other = F.get(grams, at + step * j)
            blocks = other < own if step < 0 else other <= own
            n = F.when(F.coalesce(blocks, F.lit(True)), F.lit(j - 1)).otherwise(n)
        return n

    last = F.size(grams) - 1
    window = F.least(F.lit(w), F.size(grams))
    return F.when(F.size(grams) == 0, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(F.lit(0), last), lambda i: run(i, -1) + run(i, 1) + 1 >= window))


def winnowed(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """struct(hashes, positions): the fingerprint of a text. Null and wordless texts have none.

    Two texts that share k + w - 1 words in a row share a hash of them.
    """
    return let(_rolled_words(text, k), lambda grams: let(_chosen(grams, w), lambda at: F.struct(
        F.transform(at, lambda i: F.get(grams, i)).alias("hashes"), at.alias("positions"))))


def _rolled_words(text: Column, k: int) -> Column:
    return let(F.transform(_words(F.coalesce(text, F.lit(""))), lambda word: F.xxhash64(word)),
               lambda hashes: _rolled(hashes, k))


def digest(print_: Column) -> Column:
    """A fingerprint as 32 hex digits."""
    return F.md5(F.concat_ws(
        ";", F.array_join(print_["hashes"].cast("array<string>"), " "),
        F.array_join(print_["positions"].cast("array<string>"), " ")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints by all their hashes; 1 for two without hashes."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    every = F.size(F.array_union(a["hashes"], b["hashes"]))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, prepare) -> DataFrame:
    """Each row of (id, text) and the columns of ``prepare``, with ``next``: a struct of those of the
    row before it by id; of the last row for the first.

    Rows meet in buckets of ``SPAN`` ids, so that no task holds an unbounded range; the largest row of
    a bucket is also a guest in the next bucket that has rows. Text moves once. Repeated rows are one.
    Null ids come last.
    """
    rows = docs.select("id", "text", F.coalesce("id", F.lit(-(1 << 63))).alias("at")).withColumn(
        "bucket", F.floor(F.col("at") / SPAN).cast("long"))
    # The buckets that follow one another: ids only, ranged by bucket and linked within partitions.
    tops = rows.groupBy("bucket").agg(F.max("at").alias("top"))
    ranged = tops.repartitionByRange("bucket").sortWithinPartitions("bucket").withColumn(
        "part", F.spark_partition_id())
    within = ranged.withColumn("up", F.lead("bucket").over(Window.partitionBy("part").orderBy("bucket")))
    # One row per partition, over which the two windows run.
    parts = Window.orderBy("part")
    ends = within.groupBy("part").agg(F.min("bucket").alias("low")).select(
        "part", F.lead("low").over(parts).alias("above"),
        F.min("low").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))
    hosts = written(within.join(ends, "part").select(
        F.col("top").alias("at"), F.coalesce("up", "above", "lowest").alias("host")), "hosts")
    if hosts.count() <= HOSTS:
        hosts = F.broadcast(hosts)
    guests = rows.join(hosts, "at")
    placed = rows.select("bucket", "at", "id", "text", F.lit(False).alias("guest")).union(
        guests.select("host", "at", "id", "text", F.lit(True)))
    dealt = prepare(placed.repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy(
        F.col("guest"), F.col("at").desc(), F.col("text").desc())
    own = [c for c in dealt.columns if c not in ("bucket", "at", "guest")]
    return (
        dealt.withColumn("_before", F.lag(F.struct("at", "text", "guest")).over(order))
        .where(F.col("_before").isNull() | (F.col("_before") != F.struct("at", "text", "guest")))
        .drop("_before")
        .withColumn("next", F.lead(F.struct(*own)).over(order))
        .where(~F.col("guest")).drop("bucket", "at", "guest")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(id, print): the fingerprint of every whole text. One pass without a shuffle."""
    return docs.select(
        F.col(id_col).alias("id"), winnowed(F.col(text_col), k, w).alias("print"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Compare each text with an edited text and with the next text, by descending id.

    In the edited text the last floor(n / 2) code points are replaced by as many from the start of the
    next text (all of it, if shorter). Returns id, n_chars, edited, print, edited_print, near_edited,
    near_next. Null texts are empty; a single row is its own next; repeated rows are one row; null
    ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    paired = with_next(rows, lambda d: d.withColumn("print", winnowed(F.col("text"), k, w)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return (
        paired.withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(
            F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)))
        .withColumn("edited_print", winnowed(F.col("edited"), k, w))
        .select(
            "id", "n_chars", "edited", "print", "edited_print",
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next.print")).alias("near_next"))
    )

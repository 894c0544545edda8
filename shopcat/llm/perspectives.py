"""Chat formatting: each participant's view of a dialogue, with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import written

TURNS = 256  # turn numbers of one rendered part
ROWS = 1024  # turns of one rendered part, where many turns share a number
BROADCAST_ROWS = 500_000
ASSISTANT, USER = "assistant", "user"


def _escaped(text: Column) -> Column:
    """Text that can't be taken for a header or an end mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table that is broadcast if its rows, of a few dozen bytes each, are few enough."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", turns_per_part: int = TURNS, rows_per_part: int = ROWS,
) -> DataFrame:
    """Render every dialogue once per participant, with this speaker as assistant.

    Returns conv_id, perspective, part, n_turns, rendered, mask. ``rendered`` has for each turn a header
    line, the text and an end mark: ``<|assistant|>`` for the participant's own turns, and
    ``<|user name=...|>`` for all others. ``mask`` lists the spans (start, stop; code points of
    ``rendered``, stop excluded) to be trained on: the text and end mark of the participant's turns.

    A dialogue of up to ``rows_per_part`` turns is one part, whatever their numbers. A longer one is spread
    over tasks: a part holds ``turns_per_part`` turn numbers; where these have over ``rows_per_part`` turns, each number has parts of its own, split by a hash of speaker
    and text. The rows of one perspective, sorted by ``part`` and put together, are the whole dialogue.

    Turns with the same number are ordered by that hash; a row repeated over ``rows_per_part`` times comes
    after the others of its number. Repeated rows are repeated turns. A null turn number comes last, a
    null speaker is the participant ``unknown``, and a null text is empty. Marks inside texts and names
    are escaped. Null dialogue ids form one dialogue. An empty table gives an empty result.
    """
    last = F.lit((1 << 63) - 1)
    named = turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), last).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        _escaped(F.col(text)).alias("text"),
    )
    keyed = named.select(
        "*", F.struct("conv_id").alias("key"), (F.col("turn") - F.pmod("turn", F.lit(turns_per_part))).alias("block"),
        F.shiftrightunsigned(F.xxhash64("speaker", "text"), 1).alias("hash"))
    # What is too large for one part is found without moving texts: at most one row for each
    # ``rows_per_part`` turns, in each of the four tables.
    long = keyed.groupBy("key").agg(F.count("*").alias("n")).where(
        F.col("n") > rows_per_part).select("key", F.lit(True).alias("long"))
    crowded = keyed.groupBy("key", "block").agg(F.count("*").alias("n")).where(
        F.col("n") > rows_per_part).select("key", "block", F.lit(True).alias("split"))
    equal = keyed.groupBy("key", "turn", "hash").agg(F.count("*").alias("n"))
    repeated = _small(equal.where(F.col("n") > rows_per_part), "repeated")
    busy = equal.where(F.col("n") <= rows_per_part).groupBy("key", "turn").agg(
        F.sum("n").alias("rows")).where(F.col("rows") > rows_per_part)
    slices = F.ceil(F.coalesce("rows", F.lit(1)) / rows_per_part)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    cut = F.array("turn", zero, F.floor(F.col("hash") / F.pow(F.lit(2.0), F.lit(63)) * slices), zero)
    single = (
        keyed.join(_small(long, "long"), "key", "left").join(_small(crowded, "crowded"), ["key", "block"], "left").join(_small(busy, "busy"), ["key", "turn"], "left")
        .join(repeated.select("key", "turn", "hash", "n"), ["key", "turn", "hash"], "left").where("n IS NULL")
        .select("key", F.when(F.col("long").isNull(), F.array(zero)).when(
            F.col("split").isNull(), F.array("block")).otherwise(cut).alias("part"),
                "turn", "hash", "speaker", "text", one.alias("times"))
    )
    # A row that is repeated more often than a part is long is moved once, with its number.
    runs = F.sequence(zero, F.floor((F.col("n") - 1) / rows_per_part))
    often = (
        keyed.join(repeated, ["key", "turn", "hash"]).groupBy("key", "turn", "hash").agg(
            F.first("n").alias("n"), F.min("speaker").alias("speaker"), F.min("text").alias("text"))
        .withColumn("run", F.explode(runs))
        .select("key", F.array("turn", one, "hash", "run").alias("part"), "turn", "hash", "speaker", "text",
                F.least(F.lit(rows_per_part).cast("long"), F.col("n") - F.col("run") * rows_per_part).alias("times"))
    )
    people = keyed.select("key", F.col("speaker").alias("perspective")).distinct()
    parts = single.union(often).groupBy("key", "part").agg(F.sort_array(F.collect_list(
        F.struct("turn", "hash", "speaker", "text", "times"))).alias("turns"))
    views = parts.join(people, "key").select(F.col("key.conv_id").alias("conv_id"), "perspective", "part", "turns")

    def segment(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        name = F.replace(_escaped(t["speaker"]), F.lit("|>"), F.lit("|\\>"))
        head = F.when(own, F.lit(f"<|{ASSISTANT}|>\n")).otherwise(
            F.concat(F.lit(f"<|{USER} name="), name, F.lit("|>\n")))
        body = F.concat(t["text"], F.lit("<|end|>\n"))
        return F.struct(
            own.alias("own"), F.char_length(head).cast("long").alias("skip"),
            (F.char_length(head) + F.char_length(body)).cast("long").alias("size"),
            F.concat(head, body).alias("rendered"))

    repeated = F.flatten(F.transform("turns", lambda t: F.array_repeat(segment(t), t["times"].cast("int"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def span(state: Column, s: Column) -> Column:
        end = state["at"] + s["size"]
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(state["spans"], F.array(F.struct(
            (state["at"] + s["skip"]).alias("start"), end.alias("stop"))))).otherwise(state["spans"]).alias("spans"))

    return views.withColumn("segments", repeated).select(
        "conv_id", "perspective", "part", F.size("segments").cast("long").alias("n_turns"),
        F.array_join(F.col("segments")["rendered"], "").alias("rendered"),
        F.aggregate("segments", start, span, lambda s: s["spans"]).alias("mask"))

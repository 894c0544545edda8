"""The registered queries of the operators, one each, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcat.llm import (
    align, bpe, decontaminate, mixing, perspectives, resample, simhash, toxicity, trie, urlrules, vectors, warc, winnow)
from shopcat.llm.common import table, written
from shopcat.session import work_folder

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_sorted_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate vectors by sorted projection passes."""
    near = vectors.near_vectors(table(spark, sf, "embeddings"))
    return near.withColumnRenamed("id", "vec_id")


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document, by digest."""
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


def op3_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnow.edits(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.digest(F.col("print")).alias("fingerprint"),
        winnow.digest(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    """Every dialogue as each of its participants sees it; parts and spans as text."""
    views = perspectives.perspectives(table(spark, sf, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    return views.withColumn("part", F.array_join(F.col("part").cast("array<string>"), ".")).withColumn(
        "mask", F.array_join(spans, " "))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mixture of sources by weight takes from each document."""
    docs = table(spark, sf, "documents")
    sizes = written(docs.select(F.col("doc_id").alias("id"), "source", mixing.size_of(F.col("text")).alias("size")), "sizes")
    return mixing.balanced(sizes).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """A WARC record per page, written to a content-addressed archive and read back."""
    path = work_folder(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.read_records(spark, path)


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of documents by SimHash."""
    near = simhash.near_duplicates(table(spark, sf, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that importance resampling towards good quality takes, with their weights."""
    keys, _ = resample.resampled(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return keys.where("kept").select("doc_id", "log_weight", "key")


def op9_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict for every page's url, by explicit and mined rules."""
    return urlrules.judged(table(spark, sf, "pages"), table(spark, sf, "labels"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """A toxicity score for every document by compression distance."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    scores = toxicity.scored(docs.select("doc_id", "text"), model)
    return scores.select(
        "doc_id", (~toxicity.learning_rows(scores)).alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICTED).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Where a byte-level BPE and a sentencepiece model cut every document at the same byte."""
    return align.alignment(
        table(spark, sf, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row per node."""
    return trie.prefix_trie(table(spark, sf, "conversations"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of every document stand in runs that benchmark items have too, and in which items."""
    hits = decontaminate.decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (
    op1_sorted_passes, op2_bpe, op3_winnowing, op4_perspectives, op5_mixing, op6_warc, op7_simhash,
    op8_resampling, op9_url_rules, op10_toxicity, op11_alignment, op12_prefix_trie, op13_decontamination)}

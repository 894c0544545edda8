"""A corpus pipeline: quality, toxicity, near-duplicates, mixture and tokens of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopcat.llm import bpe, mixing, resample, simhash, toxicity
from shopcat.llm.common import table, written
from shopcat.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling towards good quality takes."""
    return resample.accepted(docs, table(spark, sf_dir, "labels"))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a toxicity score under the threshold."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of fingerprints that differ in 3 bits or fewer, over 3-word shingles."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, by digest."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("toxicity", nontoxic),
    ("SimHash near-dedup", distinct),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express n-gram models, compression lengths or BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs

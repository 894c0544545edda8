"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shopcat.llm.common import and_column, written

TOXIC, ORDINARY = 4_000, 8_000  # labelled documents at most that the dictionaries and scores are fit on
WINDOW = 6  # words whose compressed lengths are compared
LANGUAGE = 8_192  # bytes of ordinary language that both dictionaries share
TERMS = 400  # toxic words in a dictionary at most
SAMPLES = 20_000  # windows of ordinary text that train the shared part
STEPS = 8  # differences of lengths that are told apart
PREDICTED = 0.3
RIDGE = 1.0
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(found: list[str], size: int = WINDOW) -> list[bytes]:
    return [f" {' '.join(found[i: i + size])} ".encode("utf-8", "surrogatepass") for i in range(0, len(found), size)]


@dataclass
class Model:
    """Everything a score needs: a few kilobytes."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def features(self, texts: Iterator[str | None]) -> np.ndarray:
        toxic, ordinary = _compressor(self.toxic), _compressor(self.ordinary)
        out = []
        for text in texts:
            gains = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(words(text))] or [0])
            at_least = np.array([(gains >= k).sum() for k in range(2, STEPS)], float)
            top, size = np.sort(gains)[::-1], math.log1p(len(gains))
            logs = np.log1p(at_least)
            out.append(np.concatenate([at_least / len(gains), logs, logs * size, [top[0], top[:2].sum(), gains.mean(), size]]))
        return np.array(out).reshape(-1, 3 * (STEPS - 2) + 4)

    def scores(self, texts: Iterator[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.spread
        return _logistic(np.hstack([x, np.ones((len(x), 1))]) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor for short windows: no frame fields, matches from three bytes on."""
    params = zstandard.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of ``samples``; too few of them are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=32).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def learning_rows(labels: DataFrame) -> Column:
    """Labels may be learned from the documents for which this holds; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> DataFrame:
    """(toxic, text) of at most so many labelled documents, by hash of doc_id; no text is shuffled.

    A document with labels of both kinds is toxic; null labels are none.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learning_rows(labels)).groupBy("doc_id").agg(
        (F.max("toxic") >= 1).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marks.where("toxic").orderBy(order).limit(toxic).union(marks.where("NOT toxic").orderBy(order).limit(ordinary))
    return written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(written(chosen, "chosen")), "doc_id").select("toxic", "text"), "sample")


def terms(rows: DataFrame, most: int = TERMS) -> list[tuple[str, int]]:
    """(word, contexts): words that mark toxic documents.

    Words are counted once per context (the words before and after), so copies of a text count once. A
    word is kept if it is at least six times as frequent in toxic text, by a likelihood ratio that chance would
    hardly reach among all words tried.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, found, keys = [], [], []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for a, b, c in zip(["", *w], w, [*w[1:], ""]):
                    marks.append(mark)
                    found.append(b)
                    keys.append(xxhash.xxh3_64_intdigest(f"{a} {c}") >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.bool_()), pa.array(found, pa.string()), pa.array(keys, pa.int64())],
                ["toxic", "word", "context"])

    seen = rows.mapInArrow(contexts, "toxic boolean, word string, context long").where(F.length("word") >= 3).distinct()
    counts = written(seen.groupBy("word").agg(
        F.sum(F.col("toxic").cast("long")).alias("a"), F.sum((~F.col("toxic")).cast("long")).alias("b")), "counts")
    tried = counts.where("a >= 3")
    total, n = counts.agg(F.sum("a"), F.sum("b")).first(), tried.count()
    if not n or not total[0] or not total[1]:
        return []
    share = total[0] / (total[0] + total[1])
    both = F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (both * share)) + F.when(
        F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - share)))).otherwise(0))
    found = tried.withColumn("ratio", ratio).where(
        (F.col("a") / total[0] >= 6 * (F.col("b") + 0.5) / total[1]) & (F.col("ratio") >= 2 * math.log(n) + 2))
    best = found.orderBy(F.desc("ratio"), "word").limit(most).select("word", "a").collect()
    return [(r["word"], r["a"]) for r in best]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and score from a bounded sample of labelled documents.

    Both dictionaries end in the same ordinary language, trained on windows of ordinary texts. Before it, the
    toxic one has what zstandard finds in the words that mark toxic text, and the ordinary one nothing that
    could match; so lengths differ only where a window repeats toxic text, and offsets cost the same. The
    score is a logistic function of how many windows gain how many bytes.
    """
    rows = sample(docs, labels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column(0).to_pylist() for w in windows(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["window"])

    plain = rows.where("NOT toxic").select("text").mapInArrow(cut, "window binary").distinct()
    pool = sorted(r[0] for r in plain.orderBy(F.xxhash64("window"), "window").limit(SAMPLES).collect())
    marks = terms(rows)
    repeated = [f" {w} ".encode() for w, n in marks for _ in range(min(n, 50))]
    random.Random(0).shuffle(repeated)
    content = trained(repeated, 4096) if repeated else b""
    content += b"".join(f" {w} ".encode() for w, _ in reversed(marks) if f" {w} ".encode() not in content)
    random.Random(0).shuffle(pool)
    shared = trained(pool, LANGUAGE) if pool else b""
    model = Model(content + shared, bytes(len(content)) + shared, np.zeros(1), np.ones(1), np.zeros(1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    known = rows.mapInArrow(measure, "toxic boolean, x array<double>").collect()  # TOXIC + ORDINARY rows at most
    return _calibrated(model, known)


def _calibrated(model: Model, known: list) -> Model:
    x = np.array([r["x"] for r in known]).reshape(-1, 3 * (STEPS - 2) + 4)
    y = np.array([float(r["toxic"]) for r in known])
    order = np.lexsort([*x.T, y])  # the same sums in any order of rows
    x, y = x[order], y[order]
    model.mean, model.spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.hstack([(x - model.mean) / model.spread, np.ones((len(x), 1))])
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    for _ in range(30):
        p = _logistic(x @ weights)
        slope = x.T @ (p - y) + ridge * weights
        weights -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), slope)
    model.weights = weights
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) to ``docs``, from the whole text alone.

    Null and empty texts get the score of a text without any gain. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(text_col).to_pylist())
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    return kept.mapInArrow(run, and_column(kept, "score", DoubleType()))


def accepted(docs: DataFrame, labels: DataFrame, least: float = PREDICTED) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``; without labels, all."""
    columns = docs.columns
    rows = scored(docs.toDF(*[f"_{k}" for k in range(len(columns))]), fit(docs, labels), f"_{columns.index('text')}")
    return rows.where(F.col("score") < least).drop("score").toDF(*columns)

"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shopcat.llm.common import and_column, written

BUCKETS = 1 << 14  # hashed unigrams and bigrams
SAMPLE = 50_000  # labelled documents at most that set the threshold
PRIOR = 0.25
SEED = 11
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Grams:
    """Hashed unigrams and bigrams of a text, as bucket numbers."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def _hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            out = [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
            out = [known[t] for t in tokens]
        return np.array(out, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        h = self._hashes(TOKEN.findall(text or ""))
        pairs = (((h[:-1] * 0x9E3779B1) ^ h[1:]) * 0x85EBCA6B & 0x7FFFFFFF) >> 7
        pairs[h[:-1] == h[1:]] = 0  # a token and itself again is one gram, whatever the token
        return np.concatenate([h, pairs]) % self.buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(model, bucket, n): n-grams of whole texts by ``model``; one row per task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(buckets), {}
        for batch in batches:
            for model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if model not in sums:
                    sums[model] = np.zeros(buckets, np.int64)
                sums[model] += np.bincount(grams(text), minlength=buckets)
        for model, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                ["model", "bucket", "n"])

    counted = docs.select("model", "text").mapInArrow(count, "model string, bucket int, n long")
    return counted.groupBy("model", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(target: dict[int, int], raw: dict[int, int], buckets: int) -> np.ndarray:
    """log(target share / raw share) of each bucket.

    The target model is smoothed towards the raw one by a share of ``PRIOR`` of its own n-grams, so that
    what few labelled documents lack does not count against a document. Without target it is 0.
    """
    n, m = np.ones(buckets), np.zeros(buckets)
    for bucket, more in raw.items():
        n[bucket] += more
    for bucket, more in target.items():
        m[bucket] += more
    n /= n.sum()
    if not m.sum():
        return np.zeros(buckets)
    m += PRIOR * m.sum() * n
    return np.log(m / m.sum()) - np.log(n)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Add ``log_weight``: the sum over a text's n-grams of log(target share / raw share)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(shared.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = [float(shared.value[grams(t)].sum()) for t in texts]
            yield batch.append_column("log_weight", pa.array(values, pa.float64()))

    return docs.mapInArrow(run, and_column(docs, "log_weight", DoubleType()))


def threshold(scored: list[tuple[float, int]]) -> float:
    """The weight that parts good from bad labels with the fewest mistakes on either side."""
    x = np.array(sorted(scored), float).reshape(-1, 2)
    if not len(x) or len(set(x[:, 1])) < 2:
        return float("-inf")
    good, bad = (x[:, 1] == 1), (x[:, 1] == 0)
    # At a cut before row k: good rows lost before it, bad rows kept after it; as shares.
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    kept = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(lost + kept == (lost + kept).min())
    k = int(best[len(best) // 2])
    low = x[k - 1, 0] if k else x[0, 0] - 2
    high = x[k, 0] if k < len(x) else x[-1, 0] + 2
    return float((low + high) / 2)


@dataclass
class Resampler:
    """What decides on a document: one number per bucket, and the least key taken."""

    ratio: np.ndarray
    threshold: float
    least: float | None = None


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> Resampler:
    """The ratio of the two models and the threshold of their weights.

    The raw model counts the n-grams of all documents. At most ``sample`` labelled documents, by hash of
    doc_id, are used: three of four make the target model if their quality is 1, and the fourth sets the
    threshold. The ids of this sample are broadcast, so no text is shuffled. Conflicting labels of a
    document count as the lower one, null labels as none.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    chosen = F.broadcast(written(
        marks.orderBy(order).limit(sample).withColumn("_fold", F.pmod(order, F.lit(4))), "chosen"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id", "left")
    model = F.when((F.col("_quality") == 1) & (F.col("_fold") > 0), "target").otherwise("rest")
    counted = bucket_counts(rows.select(model.alias("model"), "text"), buckets).collect()  # two rows per bucket at most
    target, raw = {}, {}
    for r in counted:
        raw[r["bucket"]] = raw.get(r["bucket"], 0) + r["n"]
        if r["model"] == "target":
            target[r["bucket"]] = r["n"]
    ratio = log_ratio(target, raw, buckets)
    known = log_weights(rows.where("_fold = 0"), ratio).select("log_weight", "_quality").collect()  # of the sample
    return Resampler(ratio, threshold([(r[0], r[1]) for r in known]))


def keyed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """Add ``log_weight`` and ``key``, the weight with Gumbel noise.

    The noise is a hash of doc_id, text and ``seed``, so reruns agree.
    """
    weighed = log_weights(docs.drop("log_weight", "key"), ratio)
    hashed = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
    return weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def resampled(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> tuple[DataFrame, Resampler]:
    """((doc_id, log_weight, key, kept), model): importance resampling of all ``docs``.

    The number k of documents to take is that of documents whose weight reaches the threshold, counted
    over all. Taken are those with the k largest keys: a sample without replacement in proportion to the
    weights. The k-th largest key is found by counting keys in ever finer ranges, not by sorting.

    Null texts are empty: they have weight 1. Without labels of both kinds every document is taken.
    Repeated rows share a key and stay or go together.
    """
    model = fit(docs, labels, buckets)
    keys = written(keyed(docs.select("doc_id", "text"), model.ratio, seed).drop("text"), "keys")
    k = keys.where(F.col("log_weight") >= model.threshold).count()
    model.least = kth_largest(keys, "key", k)
    return keys.withColumn("kept", F.lit(False) if model.least is None else F.col("key") >= model.least), model


def kth_largest(df: DataFrame, column: str, k: int, parts: int = 4096) -> float | None:
    """The k-th largest value, by counts over ever narrower ranges (``parts`` rows each)."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    above = 0  # values over ``high``
    while low < high:
        width = (high - low) / parts
        if not low < low + width < high:
            break
        at = F.least(F.lit(parts - 1), F.floor((F.col(column) - low) / width))
        bins = df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
        else:
            break
        if b["n"] <= 1:
            break
    # All values left in the range differ by less than a float can part, or are one.
    return low


def accepted(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the resampling takes.

    Keys are taken anew from the texts, which costs less than to move the texts to a table of keys.
    """
    _, model = resampled(docs, labels, seed=seed)
    if model.least is None:
        return docs.where(F.lit(False))
    columns = docs.columns
    inner = docs.select("doc_id", "text", F.struct(*columns).alias("_row"))
    return keyed(inner, model.ratio, seed).where(F.col("key") >= model.least).select("_row.*")

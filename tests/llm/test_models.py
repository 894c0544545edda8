"""Quality and toxicity: brute force of the selection, and accuracy on held-out labels."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopcat.llm import resample, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    order = scores.argsort()
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (ranks[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 50, [float(i) for i in range(100)], [0.1, 0.1, 5.0, -3e9, 7e8, 0.1], [1e-300, 2e-300, 1.0]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (0, 1, 2, len(values) // 2, len(values), len(values) + 3):
        want = None if k <= 0 or not values else sorted(values, reverse=True)[min(k, len(values)) - 1]
        assert resample.kth_largest(df, "x", k, parts=3) == want


def test_selection_takes_the_largest_keys(docs, labels):
    keys, model = resample.resampled(docs, labels)
    rows = keys.collect()
    k = sum(r["log_weight"] >= model.threshold for r in rows)
    want = sorted((r["key"] for r in rows), reverse=True)[:k]
    assert sorted((r["key"] for r in rows if r["kept"]), reverse=True) == want
    again, _ = resample.resampled(docs.repartition(5), labels)
    assert {r["doc_id"] for r in again.collect() if r["kept"]} == {r["doc_id"] for r in rows if r["kept"]}


def test_weights_equal_a_plain_sum(spark, docs, labels):
    model = resample.fit(docs, labels)
    grams, some = resample.Grams(), docs.limit(20)
    got = {r["doc_id"]: r["log_weight"] for r in resample.log_weights(some, model.ratio).collect()}
    for r in some.collect():
        assert math.isclose(got[r["doc_id"]], sum(model.ratio[b] for b in grams(r["text"])), rel_tol=1e-9, abs_tol=1e-9)


def test_good_documents_stay_and_poor_ones_go(docs, labels):
    kept = resample.accepted(docs, labels).select("doc_id").join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    total = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert kept[1] >= 0.985 * total[1] and kept.get(0, 0) <= 0.1 * total[0]


def test_noise_is_gumbel(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    keys = np.array([r["key"] for r in resample.keyed(rows, np.zeros(16)).collect()])
    assert abs(keys.mean() - 0.5772) < 0.03 and abs(keys.std() - math.pi / math.sqrt(6)) < 0.03


def test_odd_rows_of_a_selection(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "good words here", 5), (3, "good words here", 5), (None, "!! !! !!", 5), (4, "bad !! !!", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumn("_fold", F.lit(1))
    marks = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = resample.accepted(odd, marks)
    assert got.columns == odd.columns and {tuple(r)[:3] for r in got.collect()} <= set(rows)
    assert resample.accepted(odd, marks.limit(0)).count() == len(rows)
    assert resample.accepted(odd.limit(0), marks).count() == 0


def test_toxicity_on_held_out_labels(docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs.join(labels, "doc_id").select("doc_id", "text", "toxic"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc([r["score"] for r in held], [r["toxic"] for r in held]) > 0.85
    clean = [r for r in held if r["toxic"] == 0]
    assert sum(r["score"] >= toxicity.PREDICTED for r in clean) <= 0.06 * len(clean)
    plain = toxicity.Model.scores(model, [r["text"] for r in rows[:10]])
    assert np.allclose(plain, [r["score"] for r in rows[:10]])


def test_held_out_labels_are_never_learned(docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity.learning_rows(labels), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.fit(docs.limit(1500), x) for x in (labels, flipped))
    assert a.toxic == b.toxic and np.allclose(a.weights, b.weights)


def test_odd_rows_of_toxicity(spark):
    rows = [(1, None), (2, ""), (3, "you idiot " * 30), (3, "you idiot " * 30), (None, "x" * 100_000), (5, "\U0001f600 1 2 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_0", F.lit(1))
    marks = spark.createDataFrame([(3, 1), (5, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.accepted(docs, marks)
    assert got.columns == docs.columns and {tuple(r)[:2] for r in got.collect()} <= set(rows)
    assert toxicity.accepted(docs.limit(0), marks).count() == 0
    assert toxicity.fit(docs, marks.limit(0)).scores(["a", None]).shape == (2,)

"""The pipeline as a whole, and the queries' registration."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from shopcat.llm import mixing, resample, toxicity
from shopcat.llm.oracle import ORACLE
from tests.compare import oracle_rows, spark_rows
from tests.llm.test_pairs import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_and_names():
    names = E.queries().keys()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    assert spark_rows(spark, name, SF) == oracle_rows(name, SF)


def test_pipeline_equals_its_parts_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    keys, _ = resample.resampled(docs, labels)
    good = {r["doc_id"] for r in keys.collect() if r["kept"]}
    rows = [r for r in rows if r["doc_id"] in good]
    first = spark.createDataFrame(rows, docs.schema)
    scores = toxicity.fit(first, labels).scores([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < toxicity.PREDICTED]
    keep = {c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in keep]
    sizes = spark.createDataFrame(
        [((r["doc_id"], 0), r["source"], len(r["text"].encode().split())) for r in rows],
        "id struct<doc_id: long, hash: long>, source string, size long")
    total = sum(r["copies"] * r["size"] for r in mixing.balanced(sizes).collect())
    want_words = sum(len(r["text"].encode().split()) for r in rows)
    assert abs(total - want_words) <= 0.05 * want_words
    got = corpus_pipeline.run(spark, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {r["doc_id"]: r for r in rows}
    n = {}
    for r in got:
        assert r["n_tokens"] == len(t.encode(by_id[r["doc_id"]]["text"], add_special_tokens=False).ids)
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert max(n.values()) <= 3
    taken = sum(k * len(by_id[d]["text"].encode().split()) for d, k in n.items())
    assert abs(taken - want_words) <= 0.05 * want_words


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0

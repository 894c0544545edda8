"""BPE, winnowing and chat formatting against brute force."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopcat.llm import bpe, perspectives, winnow

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World! it's I'M we'll they'd 've", "<|endoftext|> a<|startoftext|>b <|endoftext", "ΣΑΣ Σ ς İstanbul",
    "été é", "12 345 ½ ²", "日本語テキスト 漢字", "a b c\x1cd\x85e", "\U0001f600\U0001f600 x", "tab\tnew\nline\x0b\x0c",
    "'''s ''s 's's", "word " * 3000, "x" * 5000, "don't DON'T", "a.b,c;d", "​zero﻿width", "ﬁ ligature Ǆ ǆ", "w1234 w5678 rare1 rare2",
]


def want_digests(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 200, 8 << 20])
def test_bpe_equals_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).repartition(3)
    got = sorted((tuple(r) for r in bpe.digests(df, PATH).collect()), key=repr)
    assert got == want_digests(rows)


def test_bpe_on_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in bpe.digests(df, PATH).collect()), key=repr)
    assert got == want_digests(rows)


def test_bpe_round_trip_through_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = bpe.decode(bpe.encoded(df, PATH), PATH)
    t = Tokenizer.from_file(PATH)
    for r in back.collect():
        ids = t.encode(TEXTS[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_words_of_printable_ascii_need_no_normalizer():
    split = bpe.Splitter(PATH)
    units = ["Don't", "'''s", "''S's", "A.B,c;d", "w1234x", "(x)", "'LL've'd", "x<y|z", "...", "99%", "it'sX", "A's.", "a_b-C/9"]
    want = [bpe.WORDS.findall(split.tokenizer.normalizer.normalize_str(unit)) for unit in units]
    split.tokenizer = None
    assert [split.words(unit) for unit in units] == want


def test_bpe_without_documents(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def turned(x, n):
    return ((x << n) | (x >> (64 - n))) & ((1 << 64) - 1)


def brute_winnow(hashes, k=winnow.GRAM, w=winnow.WINDOW):
    """Fingerprint from word hashes (signed), window by window."""
    h = [x & ((1 << 64) - 1) for x in hashes]
    grams = []
    for i in range(max(1, len(h) - k + 1) if h else 0):
        g = 0
        for x in h[i: i + k]:
            g = turned(g, 1) ^ x
        grams.append(g - (1 << 64) if g >> 63 else g)
    chosen = set()
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        part = grams[i: i + w]
        chosen.add(max(j for j, g in enumerate(part, i) if g == min(part)))
    return [grams[i] for i in sorted(chosen)], sorted(chosen)


WINNOW = [None, "", "  ", "one", "one two three", "a b c d e", "a b c d e f", "a a a a a a a a a a a a", "q" * 100,
          " ".join(f"w{i * i % 37}" for i in range(200)), "x y " * 60, "\U0001f600 smile é"]


def test_winnowing_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WINNOW)], "doc_id long, text string")
    words = df.select("doc_id", F.transform(winnow._words(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)).alias("h"))
    hashes = {r["doc_id"]: r["h"] for r in words.collect()}
    for r in winnow.fingerprints(df).collect():
        assert (r["print"]["hashes"], r["print"]["positions"]) == brute_winnow(hashes[r["id"]])


def test_equal_passages_share_a_hash(spark):
    shared = " ".join(f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    df = spark.createDataFrame([(0, f"p q r {shared} t u"), (1, f"k {shared} l m n o")], "doc_id long, text string")
    a, b = (set(r["print"]["hashes"]) for r in winnow.fingerprints(df).orderBy("id").collect())
    assert a & b


@pytest.mark.parametrize("step", [1, 5000, 123456789012])
def test_edits_meet_the_next_document(spark, step):
    texts = [t or "" for t in WINNOW] + ["same words here again", "same words here again", "\U0001f600" * 7]
    rows = [((i - 4) * step, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[2]], "doc_id long, text string").withColumn("at", F.lit(1)).repartition(3)
    got = {r["id"]: r for r in winnow.edits(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert (got[doc_id]["n_chars"], got[doc_id]["edited"]) == (len(text), edited)
        assert 0 <= got[doc_id]["near_edited"] <= 1
        if text == nxt:
            assert got[doc_id]["near_next"] == 1
        if edited == text:
            assert got[doc_id]["near_edited"] == 1


def test_edits_of_one_and_no_document(spark):
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    assert winnow.edits(one).first()["edited"] == "a b a b"[:4] + "a b"
    assert winnow.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "x y")], "doc_id long, text string")
    assert {r["id"] for r in winnow.edits(nulls).collect()} == {None, 1}


def whole(rows):
    """(conv, perspective) -> rendered dialogue and trained text, from parts in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (repr(r["conv_id"]), r["perspective"], r["part"])):
        text, trained = out.get((r["conv_id"], r["perspective"]), ("", []))
        assert all(a["stop"] <= b["start"] for a, b in zip(r["mask"], r["mask"][1:]))
        out[r["conv_id"], r["perspective"]] = (
            text + r["rendered"], trained + [r["rendered"][s["start"]: s["stop"]] for s in r["mask"]])
    return out


def render(turns, me):
    text, trained = "", []
    for _, speaker, words in turns:
        head = "<|assistant|>\n" if speaker == me else f"<|user name={speaker}|>\n"
        text += head + words + "<|end|>\n"
        if speaker == me:
            trained.append(words + "<|end|>\n")
    return text, trained


def test_each_participant_is_assistant_once(spark):
    rows = [(1, i, s, f"text {i} é\U0001f600") for i, s in enumerate(["system", "ana", "bo", "ana", "cy"] * 3)]
    rows += [(2, i, "solo", "x") for i in range(3)] + [(None, 0, "a", "null id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(0))
    for size in (2, 256):
        got = whole(perspectives.perspectives(df, turns_per_part=size).collect())
        convs = {r[0] for r in rows}
        assert set(got) == {(c, s) for c in convs for s in {r[2] for r in rows if r[0] == c}}
        for (c, me), found in got.items():
            assert found == render([r[1:] for r in rows if r[0] == c], me)


@pytest.mark.parametrize("numbers", [range(250, 261), range(0, 5000, 1000), [-3, None, 10**15]])
def test_a_short_dialogue_is_one_part_whatever_its_numbers(spark, numbers):
    rows = [(i, conv, "ab"[k % 2], f"t{k}") for conv in (1, None) for k, i in enumerate(numbers)]
    df = spark.createDataFrame(rows, "turn long, conv_id long, role string, text string")
    got = perspectives.perspectives(df).collect()
    assert len(got) == 4 and {r["n_turns"] for r in got} == {len(numbers)}
    parted = perspectives.perspectives(df, rows_per_part=2, turns_per_part=4).collect()
    assert whole(parted) == whole(got) and len(parted) > len(got)


def test_crowded_and_odd_turns_are_whole(spark):
    rows = [(1, 0, "a", f"t{i}") for i in range(50)] + [(1, 0, "b", "same")] * 30 + [(1, 1, "a", None), (1, None, None, "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = perspectives.perspectives(df, rows_per_part=8).collect()
    assert max(r["n_turns"] for r in small) <= 24
    for me in ("a", "b", "unknown"):
        text = whole(small)[1, me][0]
        assert text.count("<|end|>\n") == len(rows) and text.count("same<|end|>") == 30
        assert text.endswith("late<|end|>\n") and all(f"t{i}<|end|>" in text for i in range(50))


def test_marks_in_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "a", "x<|end|>\n<|assistant|>\ny"), (1, 1, "b|>", "z")], "conv_id long, turn long, role string, text string")
    for text, _ in whole(perspectives.perspectives(df).collect()).values():
        assert text.count("<|end|>") == 2 and text.count("<|assistant|>") == 1


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert perspectives.perspectives(df).count() == 0

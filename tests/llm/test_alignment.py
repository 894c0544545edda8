"""Cross-tokenizer alignment against a plain walk over token bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from shopcat.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", " ", "  two  spaces ", "é日本𝒳 x́", "▁ mark", "<|endoftext|> plain <s> <0x41>", "퟿",
       "a\x00b\n\tc  ", "👩‍👩‍👧 family 👩‍👩‍👧", "Żółć\r\nżółć", "  wide", "x" * 3000, "the the the", "the the the"]


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = align.byte_alphabet()
    assert sorted(byte_of.values()) == list(range(256))
    out, links = [], []
    for text in texts:
        if not text:
            out.append(None)
            links.append([])
            continue
        data = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        names_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        names_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(names_a) != data or b"".join(names_b) != data:
            out.append(None)
            links.append([])
            continue

        def ends(names):
            at, found = 0, []
            for n in names:
                at += len(n)
                found.append(at)
            return found

        ends_a, ends_b = ends(names_a), ends(names_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        parts, own, i, j = [], [], 0, 0
        for cut in cuts:
            x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            parts.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            own.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        out.append((len(ids_a), len(ids_b), len(cuts), ";".join(parts)))
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else
            (o[0], o[1], o[2], len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
             hashlib.sha256(o[3].encode()).hexdigest()) for o, own in zip(out, links)]


def test_byte_alphabet_is_the_one_of_the_library():
    names = decoders.ByteLevel()
    for char, byte in align.byte_alphabet().items():
        if byte < 0x80:
            assert names.decode([char]) == chr(byte)


@pytest.mark.parametrize("chunk", [align.CHUNK, 40])
def test_alignment_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "KNOWN", chunk)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
           for r in align.alignment(df, A, B).collect()}
    want = brute([t for _, t in rows])
    assert got == {d: w for (d, _), w in zip(rows, want)}
    assert sum(w[0] > 0 for w in want) > 60


def test_spans_agree_with_decoded_bytes():
    both = align.Aligner(A, B)
    units = [t for t in ODD if t and "▁" not in t]
    data = [(" " + u).encode() for u in units]
    codes = both.a.encode_batch([" " + u for u in units], add_special_tokens=False)
    spans = [both.b.encode(u, return_type="proto").pieces for u in units]
    sizes = [np.array([len(x) for x in own]) for own in (codes, spans)]
    ids = [np.array([i for c in codes for i in c.ids]), np.array([p.id for own in spans for p in own])]
    ends = both._ends_a(data, codes, ids[0], sizes[0]), both._ends_b(spans, ids[1], sizes[1])
    for got, own, n, lengths in zip(ends, ids, sizes, (both.length_a, both.length_b)):
        want = np.concatenate([np.cumsum(lengths[part]) for part in np.split(own, np.cumsum(n)[:-1])])
        assert got.tolist() == want.tolist()
    assert both.align(["▁ mark", "ok"])[0] is None and both.align(["▁ mark", "ok"])[1].n_a == 1


def test_units_are_cut_only_where_both_tokenizers_cut():
    both = align.Aligner(A, B)
    assert both.cuttable
    for text in [*filter(None, ODD), "a b", "a  b c", " a\n b \tc d\x1c e", "x\u00a0y z", "a's 's it's", "1 2 3, 4"]:
        units = both.units([text])[0]
        assert " ".join(units) == text
        if len(units) > 1 and (found := both.align(units)) and all(found):
            whole = both.align([text])[0]
            assert sum(f.n_a for f in found) == whole.n_a and sum(f.n_b for f in found) == whole.n_b
            assert ";".join(f.groups for f in found) == whole.groups
    for unit in ["word,", "a.b:c", "don't,", "it's.\nNew", "é,", "x,", "A!!", "o\n\np", "e.g.,5", "▁q,", "q,▁"]:
        assert both.look_up([unit]) == both.align([unit]), unit
    both.cuttable = False
    assert both.units(["a b", None]) == [["a b"], []]


def test_groups_tile_the_text(spark):
    df = spark.createDataFrame([(1, "ab é日本"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["id"]: r["groups"] for r in align.groups(df, A, B).collect()}
    assert got[2] == got[3] == []
    assert got[1][0]["start"] == 0 and got[1][-1]["stop"] == len(" ab é日本".encode())
    assert all(x["stop"] == y["start"] for x, y in zip(got[1], got[1][1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = align.alignment(df, A, B)
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_words_are_not_searched_for_stops_and_known_parts_not_aligned_again(monkeypatch):
    class Stops:
        seen = []

        def search(self, unit):
            self.seen.append(unit)
            return pattern.search(unit)

    pattern, both = align._TAIL, align.Aligner(A, B)
    monkeypatch.setattr(align, "_TAIL", Stops())
    whole = both.align(["word,", "x.y!", "word"])
    given, run = [], both.align
    monkeypatch.setattr(both, "align", lambda units: given.append(list(units)) or run(units))
    assert both.look_up(["word", "word,", "x.y!"]) == [whole[2], whole[0], whole[1]]
    assert both.look_up(["other", "other,", "word,"])[2] == whole[0]
    assert given == [["word", "a,", "x", "a.y!"], ["other"]] and Stops.seen == ["word,", "x.y!", "other,", "word,"]


def test_few_units_are_aligned_at_a_time(monkeypatch):
    monkeypatch.setattr(align, "AT_ONCE", 2)
    both, units = align.Aligner(A, B), ["one", "two", "three", "four", "five,", "\u65e5\u672c", "\u2581"]
    want, given, run = [both.align([u])[0] for u in units], [], both.align
    monkeypatch.setattr(both, "align", lambda part: given.append(len(part)) or run(part))
    assert both.look_up(units) == want and max(given) == 2

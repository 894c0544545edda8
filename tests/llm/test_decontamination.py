"""Benchmark decontamination against a plain search for windows."""

import random
import re

import pytest

from shopcat.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, *texts in items:
        for text in texts:
            w = plain(text)
            for k in range(max(len(w) - size + 1, 1) if w else 0):
                wins.setdefault(tuple(w[k:k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, named = plain(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k:k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    named |= found
        out.append((doc, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)] + ["Été", "ÉTÉ", "日本", "don", "t", "x y"]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [(k, " ".join(words(rng.randint(8, 40)))) for k in range(12)]
    items += [(100, "short one"), (101, ""), (102, None), (103, "short one"), (None, "no id here at all"), (3, items[5][1]), (104, "!?")]
    docs = []
    for k in range(60):
        text = words(rng.randint(0, 60))
        if k % 3 == 0:
            own = plain(rng.choice(items[:12])[1])
            at = rng.randint(0, max(len(own) - 9, 0))
            text[5:5] = own[at: at + rng.randint(7, 20)]
        docs.append((k, rng.choice([" ", "\n", " - ", "\x7f", "\x00"]).join(t.upper() if rng.random() < .3 and t.isascii() else t for t in text)))
    docs += [(200, None), (201, ""), (202, "SHORT  one, short ONE short"), (203, "no id here at all"), (204, docs[0][1]), (204, docs[0][1]),
             (205, " ".join(["short one"] * 2000))]
    return docs, items


@pytest.mark.parametrize("automaton", [D.AUTOMATON, 40])
def test_hits_equal_brute_force(spark, automaton):
    docs, items = cases(automaton)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS hits", "'y' AS id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' AS window", "'z' AS item")
    rows = D.decontaminated(df, bench, automaton=automaton).collect()
    assert sorted([(r["id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=repr) == brute(docs, items)
    texts = dict(docs)
    for r in rows:
        cut = [texts[r["id"]][s["start"]:s["stop"]] for s in r["spans"]]
        assert sum(len(plain(c)) for c in cut) == r["n_hit"]
        assert all(c == c.strip(" \n\x00\x7f-,") for c in cut)


def test_questions_and_answers_are_apart(spark):
    items = [("q1", "one two three four five", "six seven eight nine ten eleven"), ("q2", None, "a b c d e f g h i j k")]
    docs = [(0, "one two three four five six seven eight nine ten"), (1, "zero two three four five six"), (2, "b c d e f g h i j k l")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, question string, answer string")
    got = D.decontaminated(df, bench, item_texts=("question", "answer")).collect()
    assert sorted([(r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got]) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.decontaminated(docs, items).collect()] == [(1, 2, 0, [])]
    assert D.decontaminated(docs.limit(0), items).count() == 0

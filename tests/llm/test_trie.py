"""The prefix trie against a plain trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from shopcat.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, family=5, head=8):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (head + 1)
        seq = own.get(c - c % family, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        children = {n[:len(node) + 1] for n in below if len(n) > len(node)}
        leaves = sum(not any(len(m) > len(n) and m[:len(n)] == n for m in below) for n in below)
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        out.append((min(c for c, _ in members), len(node), min(c for c, _ in nodes[node[:-1]]) if node else None, len(members),
                    len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(spark, rows, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table(spark, rows), **options).collect()), key=repr)


@pytest.mark.parametrize("seed,block,ids", [(1, 256, 1 << 16), (2, 2, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, block, ids):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie.end_digests, "__defaults__", (ids,))
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([None, t, t]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["yes", "no", "ä", "", None, "longer text"])))
    rows += [(500 + c, t, "user", "same") for c in range(30) for t in range(3)]  # copies
    rows += [(None, 1, "user", "lost"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (-3, 0, "user", "below"), (-5, 0, "user", "base")]
    rng.shuffle(rows)
    # A negative id minus its remainder is the one nearer to 0, as in SQL.
    want = [r for r in rows if r[0] is None or r[0] >= 0]
    assert run(spark, want) == brute(want)
    assert run(spark, rows, head=0) == brute(rows, head=0)


def test_role_and_text_are_told_apart(spark):
    rows = [(0, 0, "ab", "c"), (10, 0, "a", "bc"), (20, 0, "a:b", "c"), (30, 0, "1:ab", "c")]
    assert len(run(spark, rows, head=0)) == 5


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(0, t, "user", f"t{t % 7}") for t in range(400)] + [(1, t, "user", f"t{t % 7}") for t in range(300)]
    got = run(spark, rows, head=0)
    assert len(got) == 401
    by_depth = {r[1]: r for r in got}
    assert by_depth[300][3] == 2 and by_depth[301][3] == 1 and by_depth[0][5] == 1 and by_depth[0][6] == 2 * 300


def test_turnless_conversations_and_empty_table(spark):
    assert run(spark, []) == []
    # Conversation 11 takes all turns it can from 10, which is not there, and has no others.
    h = zlib.crc32(b"11") % 9
    assert h > 0
    rows = [(11, t, "user", "x") for t in range(h)]
    got = run(spark, rows)
    assert got == brute(rows) and got[0][:6] == (11, 0, None, 1, 0, 1)


def test_clashing_and_extra_columns(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "bot", "b"), (1, 0, "user", "a")]
    df = table(spark, rows)
    for name in ("depth", "k1", "conv", "digest", "_at"):
        df = df.selectExpr("*", f"'x' AS {name}")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df).collect()), key=repr)
    assert got == brute(rows)

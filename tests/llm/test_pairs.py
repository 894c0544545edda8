"""Vectors and SimHash against brute force."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shopcat.llm import simhash, vectors
from shopcat.llm.components import components


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200), (200, 201)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = groups({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n != c}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, least=0.9):
    ok = {}
    for i, (vid, v) in enumerate(rows):
        if vid is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    links = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least]
    n = {i: 0 for i in range(len(rows))}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = groups(range(len(rows)), links)
    low = {}
    for i, (vid, _) in enumerate(rows):
        low.setdefault(root[i], []).append(vid)
    out = []
    for i, (vid, _) in enumerate(rows):
        ids = [x for x in low[root[i]] if x is not None]
        comp = min(ids) if ids else None
        out.append((vid, n[i], comp, vid == comp))
    return sorted(out, key=repr)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):  # groups whose members are near the linking angle, and dense ones
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 25))):
            noise = rng.standard_normal(16) * (0.1 if g % 2 else 0.32)
            rows.append([float(np.float32(x)) for x in centre + noise])
    rows += [rows[0], rows[0], [x * 2 for x in rows[1]], [0.0] * 16, [float("nan")] * 16, None, [], [1.0, 2.0], [2.0, 4.0],
             [None] + [1.0] * 15, [float("inf")] * 16]
    table = [(i, v) for i, v in enumerate(rows)] + [(None, rows[2])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = [tuple(r) for r in vectors.near_vectors(df).collect()]
    want = brute_vectors(table)
    assert len(got) == len(want)
    ids = {r[0]: r for r in want if r[0] is not None}
    for r in got:
        if r[0] is not None:
            assert r == ids[r[0]]


def test_vectors_count_links_in_large_and_loose_groups(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(32) * s]) for i, s in enumerate(rng.uniform(0.02, 0.45, 700))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: tuple(r)[1:] for r in vectors.near_vectors(df).collect()}
    assert got == {r[0]: r[1:] for r in brute_vectors(rows)}


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "A b\x0bc D e f g", "Straße ÄÖ é x y", "a a a a a a a"])
def test_simhash_of_a_text(text):
    assert simhash.simhash(text) == brute_print(text)


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = groups(range(len(rows)), links)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(d, low.get(root[i], d))
    return sorted(((d, prints[i] - (1 << 64) if prints[i] >> 63 else prints[i], low.get(root[i])) for i, (d, _) in enumerate(rows)), key=repr)


def edited_texts(seed, n, base=60):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, base)]
        for _ in range(int(rng.integers(1, 5))):
            rows.append(" ".join(words))
            words = list(words)
            words[int(rng.integers(0, base))] = f"x{k}"
    return rows


def test_simhash_groups_equal_brute_force(spark):
    texts = edited_texts(1, 60) + [None, "", " ", "one", "ONE", "one two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute_groups(rows)


def test_every_pair_within_the_distance_meets_under_a_key():
    rng = np.random.default_rng(2)
    masks = simhash.first_masks()
    for _ in range(3000):
        flips = 0
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            flips |= 1 << int(b)
        met = [(s, m) for s, m in masks if not flips & m]
        assert any(all((flips & mask).bit_count() <= most for mask, most in simhash._budgets(s)) for s, m in met)
        for _, m in met:
            assert any(not flips & finer for finer in simhash.refined(m))


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    links = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    want = groups(prints, links)
    assert {p: got.get(p, p) for p in prints} == want


def test_one_document_of_each_group_stays(spark):
    texts = edited_texts(7, 20) + ["", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(2, texts[2], "en"), (None, "only here is this text", "de"),
                                                         (None, "only here is this text", "de"), (None, texts[0], "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash string")
    got = sorted((tuple(r) for r in simhash.deduplicate(df).collect()), key=repr)
    keep = {c for _, _, c in brute_groups([r[:2] for r in rows]) if c is not None}
    assert got == sorted([r for r in rows[: len(texts)] if r[0] in keep] + [(None, "only here is this text", "de")], key=repr)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def cone(n, cosine, pairs, dim=64):
    """Vectors with one mutual cosine, and ``pairs`` of them that have a partner of cosine 0.905."""
    rng = np.random.default_rng(1)
    centre = np.eye(dim)[0]
    side = rng.standard_normal((n, dim)) * (1 - centre)
    x = math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * side / np.linalg.norm(side, axis=1, keepdims=True)
    away = rng.standard_normal((pairs, dim)) * (1 - centre)
    away -= np.einsum("ij,ij->i", away, x[:pairs])[:, None] * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.concatenate([x, 0.905 * x[:pairs] + math.sqrt(1 - 0.905 ** 2) * away])


def test_lone_pairs_in_a_cone_meet(spark):
    x = cone(4000, 0.75, 150)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    root = groups(range(len(x)), near.tolist())
    got = {r["id"]: r["component_id"] for r in vectors.near_vectors(df).collect()}
    assert sum(got[i] != c for i, c in root.items()) == 0


def test_orders_follow_rows_and_density():
    x = np.random.default_rng(3).standard_normal((300, 64))
    few, many = (vectors.planned_passes(x, n, 0.9, 32, 7) for n in (1000, 10_000_000))
    assert few == vectors.PASSES < many
    assert vectors.planned_passes(cone(300, 0.7, 0), 10_000, 0.9, 32, 7) > vectors.planned_passes(x, 10_000, 0.9, 32, 7)

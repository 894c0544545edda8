"""Mixing, archives and URL rules against brute force."""

import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shopcat.llm import mixing, urlrules, warc
from shopcat.session import work_folder


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"b": 10, "a": 1000, "Z": 5, None: 40}, {"a": 0, "b": 7}, {"x": 3},
    {"a": 1, "b": 1, "c": 1000, "d": 1, "é": 2, "zz": 1}, {None: 5},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.weighted_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def mixture_rows(seed=1, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 5 + ["a", "b", "tiny", None, "Ü"])
        size = 12 if source == "hot" and r.random() < 0.5 else int(r.expovariate(1 / 60))
        rows.append((i, " ".join(["w"] * size) if r.random() > 0.02 else None, source))
    return rows


def test_mixture_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = mixture_rows()
    docs = spark.createDataFrame(rows, "id long, text string, source string").withColumn("size", mixing.size_of(F.col("text")))
    got = mixing.balanced(docs.drop("text")).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want = brute_targets(total)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["size"] == size[r["id"]] and r["source_size"] == total[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in want)
    again = mixing.balanced(docs.drop("text").repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def brute_multiplier(sizes, target):
    """The zero of the words given minus the target, by halving alone."""
    low, high = -50.0, 50.0
    for _ in range(200):
        x = (low + high) / 2
        given = sum(n * s * min(3.0, math.exp(min(x * s, 5))) for s, n in sizes.items())
        low, high = (x, high) if given < target else (low, x)
    return low


def test_documents_are_tilted_by_their_size(spark):
    r = random.Random(3)
    sources = {"down": 0.3, "little": 0.002, "up": 1.7, "most": 2.99, "full": 3.0, None: 1.0, "one": 0.5, "words": 1.2}
    classes, targets = [], []
    for source, share in sources.items():
        sizes = {"one": {20_000: 1}, "words": {1: 7}}.get(source) or {
            int(r.paretovariate(0.6)) + 1: r.randint(1, 40) for _ in range(60)}
        total = sum(s * n for s, n in sizes.items())
        classes += [(source, s, n) for s, n in [*sizes.items(), (0, 2)]]
        targets.append((source, total, share * total))
    classes.append(("empty", 0, 4))
    targets.append(("empty", 0, 0.0))
    c = spark.createDataFrame(classes, "source string, size long, n long")
    t = spark.createDataFrame(targets, "source string, size long, target double")
    got = mixing.document_rates(c, t).collect()
    assert len(got) == len(classes)
    for source, total, target in targets:
        rows = [r for r in got if r["source"] == source]
        given = sum(r["n"] * r["size"] * r["rate"] for r in rows)
        assert math.isclose(given, target, rel_tol=1e-6), source
        assert all(r["rate"] == 1 for r in rows if r["size"] == 0)
        if total and target < 3 * total:
            x = brute_multiplier({r["size"]: r["n"] for r in rows if r["size"]}, target)
            assert all(math.isclose(r["rate"], min(3, math.exp(min(x * r["size"], 5))), rel_tol=1e-4, abs_tol=1e-12) for r in rows)
    again = mixing.document_rates(c.repartition(5), t).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_rows_are_copies(spark):
    rows = mixture_rows(2, 200)
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("id", F.lit(2))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert {tuple(r)[:3] for r in got.collect()} <= set(rows)
    assert got.collect() and mixing.mixed(docs.limit(0)).count() == 0


def test_two_sets_of_constraints(spark):
    cells = spark.createDataFrame([("a", "en", 100), ("a", "de", 50), ("b", "en", 30), ("b", "de", 80), ("c", "en", 0)], "source string, lang string, size long")
    by_source = spark.createDataFrame([("a", 120.0), ("b", 140.0)], "source string, target double")
    by_lang = spark.createDataFrame([("en", 90.0), ("de", 170.0)], "lang string, target double")
    got = mixing.tilts(cells, [("source", by_source), ("lang", by_lang)]).collect()
    rate = {(r["source"], r["lang"]): r["rate"] for r in got}
    mass = lambda k, v: sum(r["size"] * r["rate"] for r in got if r[k] == v)
    assert math.isclose(mass("source", "a"), 120, rel_tol=1e-6) and math.isclose(mass("lang", "de"), 170, rel_tol=1e-6)
    # Tilts add up: the odds ratio of the cells is that of equal rates.
    assert math.isclose(rate["a", "en"] * rate["b", "de"], rate["a", "de"] * rate["b", "en"], rel_tol=1e-6)
    assert rate["c", "en"] == 0


def test_sizes_of_texts(spark):
    texts = [None, "", " \t", "a", "a b\x0bc\x0cd\re\nf", "é\xa0ü ß", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.size_of(F.col("text"))).collect()] == [len((t or "").encode().split()) for t in texts]


PAGES = [(0, "http://a/1", "<p>é</p>"), (5, "http://a/2", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "u\r\nv", None), (2, "", ""),
         (9, "http://a/9", "y" * 100_000), (None, "http://n", "<p>x</p>"), (7, "http://a/7", "\u2028\r\n\r\nWARC/1.1")]


def brute_warc(rows, least):
    first, out = {}, []
    key = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(rows, key=key):
        first.setdefault((r[2] or "").encode(), r)
    used = set()
    for r in sorted(rows, key=key):
        body = (r[2] or "").encode()
        lone = len(body) < least or (first[body] == r and body not in used)
        used.add(body)
        out.append((r[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if lone else "revisit", None if lone else first[body][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    rows = PAGES + [PAGES[1], PAGES[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("strong", F.lit("clash"))
    path = work_folder(spark, "archive")
    warc.write_archive(df, path, least)
    got = sorted((tuple(r) for r in warc.read_records(spark, path).collect()), key=repr)
    assert got == brute_warc(rows, least)
    original = warc.read_archive(spark, path).collect()
    bodies = sorted(bytes(r["body"]) for r in original)
    assert bodies == sorted((r[2] or "").encode() for r in rows)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    for r in warc.warc_records(spark, path).collect():
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_a_changed_payload_is_noticed(spark):
    path = work_folder(spark, "archive")
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("body", F.concat("body", F.lit("!").cast("binary")))
    other = work_folder(spark, "archive")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    for read in (warc.read_records, warc.read_archive):
        with pytest.raises(Exception, match="payload"):
            read(spark, other).collect()


def test_an_empty_archive(spark):
    path = work_folder(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute_rule(host, path):
    best = (None, None)
    for kind, h, p in urlrules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, kind)
    return best


URLS = [None, "", "no scheme", "http://", "http://net", "http://x.net/", "HTTP://X.NET/a?b#c", "https://example.net/en/1", "https://m.EXAMPLE.net/en",
        "http://example.com/de/2", "http://badexample.com/de/", "http://a.org/fr/x", "http://a.org/de/", "http://a.b://net/", "http://x.net?q=/en/",
        "ftp://é.org/fr/", "http://x.net\n/y", "http://evil.site.io/casino/1"]


def test_explicit_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("items", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in urlrules.judged(df, labels).collect():
        host, path = brute_parts(URLS[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(4)
    pages, labels = [], []
    for i in range(400):
        words = r.sample(["casino", "win", "news", "blog", "a", "b"], 3)
        bad = {"casino", "win"} <= set(words) if r.random() > 0.05 else r.random() < 0.5
        pages.append((i, f"http://s{r.randrange(3)}.io/" + "/".join(words)))
        if i % 2:
            labels.append((i, 0 if bad and i % 3 else 1, 1 if bad and not i % 3 else 0))
    df = spark.createDataFrame(pages + [pages[0], (None, None)], "page_id long, url string")
    parts = urlrules.with_parts(df).withColumn("items", urlrules.tokens(F.col("host"), F.col("path"), F.col("url")))
    items = {x["page_id"]: set(x["items"]) for x in parts.collect()}
    bad = {d: q == 0 or t == 1 for d, q, t in labels}
    import itertools
    rules = set()
    for tokens in {frozenset(c) for d in bad for k in range(1, 5) for c in itertools.combinations(sorted(items[d]), k)}:
        rows = [d for d in bad if tokens <= items[d]]
        hits = sum(bad[d] for d in rows)
        if hits >= 4 and hits / len(rows) >= 0.7:
            rules.add(tokens)
    want = {i for i, t in items.items() if any(x <= t for x in rules)}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["page_id"] for x in urlrules.judged(df, marks, rules=(), least=4, confidence=0.7).collect() if x["verdict"] == "block"}
    assert rules and got == want


def labelled_urls(spark, rows):
    pages = [(i, url) for i, (url, _) in enumerate(rows)]
    marks = [(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)]
    return (spark.createDataFrame(pages, "page_id long, url string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("drop", [False, True])
def test_long_urls_are_mined_in_bounded_work(spark, drop):
    """Thirty urls of 40 words each, all the same or each without another one of them; "x" and "y" tell bad ones together."""
    def url(i, *more):
        words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40) if not drop or k != i % 40]
        return "http://s.io/" + "/".join([*words, *more])

    rows = [(url(i, "x", "y"), True) for i in range(30)] + [(url(i, "x"), False) for i in range(40)] + [
        (url(i, "y"), False) for i in range(40)]
    pages, labels = labelled_urls(spark, rows)
    got = {r["page_id"] for r in urlrules.judged(pages, labels, rules=()).collect() if r["verdict"] == "block"}
    assert got == set(range(30))


def test_a_bad_host_is_blocked_among_any_number_of_rows(spark):
    for others in (2_000, 60_000):
        pages = spark.range(1000 + others).select(F.col("id").alias("page_id"), F.when(
            F.col("id") < 1000, F.concat(F.lit("http://bad.io/p"), F.col("id") % 7)).otherwise(
            F.concat(F.lit("http://s"), F.col("id") % 50, F.lit(".com/p"), F.col("id") % 7)).alias("url"))
        labels = pages.select(F.col("page_id").alias("doc_id"), F.when(
            F.col("page_id") < 1000, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
        assert urlrules.judged(pages, labels, rules=()).where("verdict = 'block'").count() == 1000


def test_url_tables_may_be_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert urlrules.judged(pages, labels).count() == 0


def test_rules_of_tokens_far_apart_in_long_urls_are_found(spark):
    """Three tokens with many others between them tell bad urls; any two of them are in good ones as well."""
    def url(i, *tokens):
        words = [c + chr(97 + k) for k in range(15) for c in "by"]
        return "http://s.org/" + "/".join([w for k, w in enumerate(words) if k != i % 30] + list(tokens))

    rows = [(url(i, "aa", "mm", "zz"), True) for i in range(30)]
    for two in (("aa", "mm"), ("aa", "zz"), ("mm", "zz")):
        rows += [(url(i, *two), False) for i in range(30)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(b)) for k, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r["page_id"] for r in urlrules.judged(pages, labels, rules=()).collect() if r["verdict"] == "block"}
    assert got == {k for k, (_, b) in enumerate(rows) if b}

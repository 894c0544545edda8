"""Matching, merging and offers, against literal cases and a row-by-row fold."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopcat.operators import catalog as C
from shopcat.schemas import BOOKS, OBSERVATIONS
from shopcat.session import work_folder
from shopcat.sources.tables import read_batches, write_books

T0 = datetime(2024, 1, 1)


def offer(value, hours, url="https://www.a.ro/1"):
    return (value, "RON", T0 + timedelta(hours=hours), url)


def observation(page_id, isbn, hours=0, title=None, authors=None, description=None, publisher=None,
                fmt=None, image=None, words=(), price=None):
    t, url = T0 + timedelta(hours=hours), f"https://www.a.ro/{page_id}"
    o = None if price is None else (page_id, price, "RON", t, url, "", "a.ro", None)
    return (page_id, url, t, title, authors, isbn, description, publisher, fmt, image, list(words), o)


def table(spark, rows):
    from decimal import Decimal
    fixed = [r[:-1] + (None if r[-1] is None else (r[-1][0], Decimal(str(r[-1][1]))) + r[-1][2:],) for r in rows]
    return spark.createDataFrame(fixed, OBSERVATIONS)


def as_dict(books):
    return {r["isbn"]: r.asDict(recursive=True) for r in books.collect()}


def test_merge_for_most_information(spark):
    rows = [observation(1, "1234567890123", 0, "Anna Karenina", "Lev Tolstoi", "Limba de lemn", words=["anna"]),
            observation(2, "1234567890123", 1, "Other", "Tolstoi", "Si mai multa limba de lemn", "P", words=["lev"])]
    book = as_dict(C.merge_books(table(spark, rows)))["1234567890123"]
    assert (book["title"], book["authors"], book["publisher"]) == ("Anna Karenina", "Lev Tolstoi", "P")
    assert book["description"] == "Si mai multa limba de lemn"
    assert book["keywords"] == ["anna", "lev"]


def test_latest_offer_wins(spark):
    rows = [observation(1, "1234567890123", 1, price=12.05), observation(2, "1234567890123", 0, price=10.05),
            observation(3, "1234567890123", 2)]
    assert float(as_dict(C.merge_books(table(spark, rows)))["1234567890123"]["best_offer"]["nominal_value"]) == 12.05


def test_equal_times_later_arrival_wins(spark):
    rows = [observation(1, "x", 1, price=1), observation(2, "x", 1, price=2)]
    assert float(as_dict(C.merge_books(table(spark, rows)))["x"]["best_offer"]["nominal_value"]) == 2


def test_short_isbn_joins_full_one(spark):
    rows = [observation(1, "978606673363", 0, "short"), observation(2, "9786066733632", 1, "valid"),
            observation(3, "9786066733631", 2, "invalid"), observation(4, "080442957", 0, "ten"),
            observation(5, "080442957X", 1), observation(6, "12345", 0), observation(7, "1234", 0),
            observation(8, "", 0, "empty"), observation(9, None, 0)]
    books = as_dict(C.merge_books(table(spark, rows)))
    assert {k: (v["title"], v["isbns"]) for k, v in books.items()} == {
        "9786066733632": ("short", ["978606673363", "9786066733632"]),
        "9786066733631": ("invalid", ["9786066733631"]),
        "080442957X": ("ten", ["080442957", "080442957X"]),
        "12345": (None, ["12345"]), "1234": (None, ["1234"]), "": ("empty", [""])}


def random_observations(n, seed):
    r = random.Random(seed)
    isbns = ["9786066733632", "978606673363", "9780306406157", "080442957X", "080442957"]
    rows = []
    for i in range(n):
        # a third of all rows are one book
        isbn = isbns[0] if r.random() < 0.34 else r.choice(isbns)
        pick = lambda p, k: f"{p}{'z' * r.randint(0, 3)}{r.randint(0, 5)}" if r.random() < k else None
        rows.append(observation(i, isbn, r.randint(0, 6), pick("t", .4), pick("a", .6), pick("d", .6), pick("p", .3),
                                pick("f", .2), pick("i", .3), sorted({f"w{r.randint(0, 30)}" for _ in range(3)}),
                                r.choice([None, 5, 6.5, 7])))
    return rows


def brute_force(rows):
    full = {r[5] for r in rows if len(r[5]) in (10, 13)}
    books = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        isbn = next((f for f in sorted(full) if f[:-1] == r[5]), r[5])
        b = books.setdefault(isbn, {"keywords": set(), "best": None})
        for f, v in zip(("title", "publisher", "format", "image_url"), (r[3], r[7], r[8], r[9])):
            b[f] = b.get(f) if b.get(f) is not None else v
        for f, v in (("authors", r[4]), ("description", r[6])):
            old = b.get(f)
            b[f] = v if old is None or (v is not None and len(v) > len(old)) else old
        b["keywords"] |= set(r[10])
        if r[11] is not None:
            b["best"] = (r[2], float(r[11][1]), r[1])
    return books


def check(books, want):
    got = as_dict(books)
    assert set(got) == set(want)
    for isbn, b in want.items():
        g = got[isbn]
        for f in ("title", "publisher", "format", "image_url", "authors", "description"):
            assert g[f] == b[f], (isbn, f)
        assert g["keywords"] == sorted(b["keywords"])
        o = g["best_offer"]
        assert (None if o is None else (o["retrieved_time"], float(o["nominal_value"]), o["url"])) == b["best"]


def test_merge_equals_row_by_row_fold_in_any_order(spark):
    rows = random_observations(300, 1)
    want = brute_force(rows)
    check(C.merge_books(table(spark, rows)), want)
    random.Random(2).shuffle(rows)
    check(C.merge_books(table(spark, rows).repartition(7)), want)


def test_upsert_in_steps_equals_one_merge(spark):
    rows = random_observations(200, 3)
    random.Random(4).shuffle(rows)
    want = brute_force(rows)
    stored = C.merge_books(table(spark, rows[:50]))
    for part in (rows[50:60], rows[60:]):
        stored = C.upsert_catalog(stored, table(spark, part))
    check(stored, want)
    parts = [C.merge_books(table(spark, rows[i::3])) for i in range(3)]
    check(C.compact_books(*parts), want)


def test_upsert_leaves_other_books_alone(spark):
    stored = C.merge_books(table(spark, [observation(1, "1111111111111", title="kept"), observation(2, "2", title="x")]))
    books = as_dict(C.upsert_catalog(stored, table(spark, [observation(3, "2", -1, title="y")])))
    assert {k: v["title"] for k, v in books.items()} == {"1111111111111": "kept", "2": "y"}
    assert set(C.upsert_catalog(stored, table(spark, [])).columns) == set(spark.createDataFrame([], BOOKS).columns)


def test_books_without_history_come_first(spark):
    stored = C.merge_books(table(spark, [observation(1, "2", 9, title="x")])).drop("seqs", "isbns")
    assert as_dict(C.upsert_catalog(stored, table(spark, [observation(3, "2", 0, title="y")])))["2"]["title"] == "x"


def test_match(spark):
    new = spark.createDataFrame([("9786066733632",), ("9786066733632",), ("5",), ("",), (None,)], "isbn string")
    stored = spark.createDataFrame([("9786066733632", 1), ("978606673363", 2), ("", 3), ("6", 4)],
                                   "isbn string, book_id bigint")
    assert sorted(map(tuple, C.match_books(new, stored).collect())) == [
        ("", "exact", "", 3), ("5", "prefix", "", 3), ("9786066733632", "exact", "9786066733632", 1),
        ("9786066733632", "prefix", "978606673363", 2)]


def test_offers_append_and_equality(spark):
    rows = [observation(i, "9", i % 3, price=5 + i % 2) for i in range(6)]
    offers = C.offer_rows(table(spark, rows), "j1")
    assert C.distinct_offers(offers.union(offers)).count() == 6
    added = C.append_offers(offers.limit(0), offers.union(offers))
    assert added.count() == 6
    assert C.append_offers(offers, offers).count() == 0
    more = C.offer_rows(table(spark, rows + [observation(7, "9", 0, price=5)]), "j2")
    assert [r["url"] for r in C.append_offers(offers, more).collect()] == ["https://www.a.ro/7"]


def test_distinct_is_null_safe(spark):
    o = spark.createDataFrame([(None, "RON", T0, "u", 1), (None, "RON", T0, "u", 2), (None, None, None, None, 3)],
                              "nominal_value decimal(18,2), currency string, retrieved_time timestamp, url string, x int")
    assert sorted(r["x"] for r in C.distinct_offers(o).collect()) == [1, 3]


def test_lookups(spark):
    books = C.merge_books(table(spark, [observation(1, "1", title="A", words=["k"], price=3), observation(2, "2", title="B")]))
    assert [r["isbn"] for r in C.find_books(books, keyword="k").collect()] == ["1"]
    assert [r["isbn"] for r in C.find_books(books, title="B").collect()] == ["2"]
    assert [r["isbn"] for r in C.find_books(books, best_offer_site="a.ro", title="A").collect()] == ["1"]
    assert C.find_books(books).count() == 2


def test_lookups_reach_the_scan_of_a_written_table(spark):
    path = work_folder(spark, "lookup")
    write_books(C.merge_books(table(spark, random_observations(20, 5))), path, 0)
    books = read_batches(spark, path, BOOKS)
    for field in ("title", "authors", "isbn"):
        plan = C.find_books(books, **{field: "x"})._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({field},x)" in plan.split("PushedFilters")[1].split("\n")[0]


def test_batches_fold_before_they_meet(spark):
    path = work_folder(spark, "fold")
    for batch in range(3):
        write_books(C.merge_books(table(spark, random_observations(20, 5))), path, batch)
    folded = C.compact_books(read_batches(spark, path, BOOKS).drop("batch"))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan.split("Exchange hashpartitioning(stem")[-1]
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, C.compact_books(read_batches(spark, path, BOOKS).where("batch = 1").drop("batch")).collect()))


def test_hot_isbn_is_reduced_before_the_shuffle(spark):
    plan = C.merge_books(table(spark, random_observations(20, 5)))._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.split("Exchange hashpartitioning(isbn")
    assert len(before_exchange) == 3 and all("partial_" in p for p in before_exchange[1:])
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_table_read_in_parts_is_not_moved(spark, tmp_path):
    """One file of many row groups is read in parts; one of a single row group is dealt out, to partitions of bounded rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from shopcat.sources.tables import spread

    rows = pa.table({"k": list(range(40_000)), "t": [f"{i * 7919 % 40_000:064x}" for i in range(40_000)]})
    paths = {}
    for name, size in (("parts", 500), ("one", 40_000)):
        paths[name] = str(tmp_path / f"{name}.parquet")
        pq.write_table(rows, paths[name], row_group_size=size, compression="none", use_dictionary=False)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        read = spread(spark.read.parquet(paths["parts"]))
        assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString() and read.count() == 40_000
        dealt = spread(spark.read.parquet(paths["one"]), rows=4_000)
        assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 40_000
        assert max(dealt.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) <= 4_000 + 10
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_running_session_takes_on_settings_it_has_not_set(spark):
    from shopcat.session import RUNTIME, SETTINGS, tune

    other, key = spark.newSession(), RUNTIME[0]
    before = spark.conf.get(key)
    try:
        other.conf.set(key, "9000")
        other.conf.unset(RUNTIME[1])
        tune(other)
        assert other.conf.get(key) == "9000" and other.conf.get(RUNTIME[1]) == SETTINGS[RUNTIME[1]]
    finally:
        assert spark.conf.get(key) == before


def test_the_fold_sorts_by_the_hash_of_the_isbn(spark):
    rows = [observation(i, "1234567890123", i, words=["a", "b"]) for i in range(6)] + [observation(9, "x", words=[])]
    fold = C.fold_observations(table(spark, rows))
    assert sorted((r["isbn"], sorted(r["words"] or [])) for r in fold.collect()) == [("1234567890123", ["a", "b"]), ("x", [])]
    plan = fold._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(book_id" in plan and "hashpartitioning(isbn" not in plan


def test_books_move_once(spark):
    """Two shuffles, of states and of words; short and full ISBNs meet in them, not in a third one by stem."""
    plan = C.merge_books(table(spark, random_observations(40, 7)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Window" not in plan


def valid(isbn):
    if len(isbn) == 13 and isbn.isdigit():
        return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(isbn)) % 10 == 0
    digits = [10 if d in "xX" and i == 9 else int(d) if d.isdigit() else -99 for i, d in enumerate(isbn)]
    return len(isbn) == 10 and min(digits) >= 0 and sum(d * (10 - i) for i, d in enumerate(digits)) % 11 == 0


def test_odd_isbns_fold_as_row_by_row(spark, monkeypatch):
    """Wrong check digits, small x, letters, and stems of which only some ISBNs came."""
    isbns = ["978606673363", "9786066733632", "9786066733631", "080442957", "080442957x", "080442957X", "978030640615", "9780306406150",
             "9780306406151", "97803064061a", "97803064061a7", "08044295", "12345", "123456789", "999999999999", "0306406152", ""]
    r = random.Random(8)
    for n in (12, 60, 200):
        rows = [observation(i, r.choice(isbns), r.randint(0, 5), r.choice([None, f"t{i}"]), "a" * r.randint(0, 4), words=[f"w{r.randint(0, 9)}"],
                            price=r.choice([None, 3, 4])) for i in range(n)]
        full = sorted((o[5] for o in rows if len(o[5]) in (10, 13)), key=lambda f: (not valid(f), f))
        renamed = [(*o[:5], next((f for f in full if f[:-1] == o[5]), o[5]), *o[6:]) for o in rows]
        want = brute_force(renamed)
        names = {k: sorted({o[5] for o, m in zip(rows, renamed) if m[5] == k}) for k in want}
        got = C.merge_books(table(spark, rows))
        check(got, want)
        assert {k: v["isbns"] for k, v in as_dict(got).items()} == names
    monkeypatch.setattr(C, "BROADCAST_BYTES", 1)
    mixed = C.merge_books(table(spark, rows))
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, got.collect()))
    assert "Window" in mixed._jdf.queryExecution().executedPlan().toString()


def test_stored_books_move_once_where_the_stems_are_many(spark):
    path = work_folder(spark, "many")
    write_books(C.merge_books(table(spark, random_observations(40, 9))), path, 0)
    stems = table(spark, [observation(1, "978606673363"), observation(2, "1234")]).selectExpr("isbn AS stem")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nameless = spark.createDataFrame([(1, None)], "book_id bigint, isbn string")
        stored = read_batches(spark, path, BOOKS).drop("batch").unionByName(nameless, allowMissingColumns=True)
        met, others = C.split_by_stem(stored, stems, False)
        both = met.unionByName(others)
        assert sorted(map(str, (r["isbn"] for r in both.collect()))) == sorted(map(str, (r["isbn"] for r in stored.collect())))
        assert [r["isbn"] for r in met.collect()] == ["9786066733632"]
        assert both._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2  # the books and the stems
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

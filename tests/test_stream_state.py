"""Streams with state of their own: offers that expire, statistics of running jobs, offers delivered twice."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shopcat.operators import jobs as J
from shopcat.session import rocksdb_state, work_folder
from shopcat.sources.tables import commit_batch, last_committed, path_exists
from shopcat.streaming import expiry, running
from shopcat.streaming import streams as S

T0 = datetime(2024, 1, 1)
OFFERS = "isbn string, offer struct<nominal_value: decimal(18,2), retrieved_time: timestamp, url: string>, seq struct<page_id: bigint, url: string>"


def offer(spark, rows):
    """(isbn, day, value, page) as offers."""
    return spark.createDataFrame(
        [(i, (v, None if d is None else T0 + timedelta(days=d, microseconds=7), f"u{p}"), (p, f"u{p}")) for i, d, v, p in rows],
        OFFERS.replace("decimal(18,2)", "double")).select(
        "isbn", F.col("offer").cast("struct<nominal_value: decimal(18,2), retrieved_time: timestamp, url: string>").alias("offer"), "seq")


def stream_of(spark, folder, batches):
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_offers_expire_and_their_state_goes(spark):
    root = work_folder(spark, "test-ttl")
    days = [
        [("a", 0, 1.0, 1), ("b", 0, 2.0, 1), ("c", 1, 3.0, 2), ("c", 1, 3.5, None), ("c", 1, 2.5, 1), ("n", None, 1.0, 1)],
        [("a", 8, 4.0, 1), ("a", 7, 9.0, 5)],  # a is seen again, b is not
        [("d", 20, 5.0, 1)],  # b's and c's time is over, a's too
        [("b", 21, 6.0, 1), ("b", 12, 7.0, 1), ("x", 5, 8.0, 1)],  # b comes back; x is later than allowed
    ]
    stream = stream_of(spark, f"{root}/in", [offer(spark, d) for d in days])
    schema = expiry.stream_current_offers(stream, "isbn", ttl="10 days", late="2 days").schema
    q = expiry.run_current_offers(stream, f"{root}/out", "isbn", ttl="10 days", late="2 days")
    q.awaitTermination()
    got = {r["isbn"]: (float(r["best_offer"]["nominal_value"]), r["best_offer"]["retrieved_time"], r["expires_at"])
           for r in expiry.read_current_offers(spark, f"{root}/out", "isbn", schema=schema).collect()}
    us = timedelta(microseconds=7)
    assert got == {"d": (5.0, T0 + timedelta(20) + us, T0 + timedelta(30) + us), "b": (6.0, T0 + timedelta(21) + us, T0 + timedelta(31) + us)}
    changes = spark.read.parquet(f"{root}/out/changes")
    expired = sorted((r["isbn"], float(r["best_offer"]["nominal_value"])) for r in changes.where("expired").collect())
    assert expired == [("a", 4.0), ("c", 3.0)]  # b is replaced in the batch in which it would go
    # The larger sequence wins among equal times, and an older offer changes nothing.
    assert [float(r["best_offer"]["nominal_value"]) for r in changes.where("isbn = 'c' AND NOT expired").collect()] == [3.0]
    assert changes.where("isbn = 'a' AND NOT expired").count() == 2
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) >= 3 and states[-1] == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def pages(n, seed):
    r = random.Random(seed)
    return [("hot" if r.random() < .7 else "j", None if i < 5 else T0 + timedelta(seconds=i * 10 + r.randint(0, 200)), i,
             1 + i % 2, i % 3 > 0, "PRODUCT" if i % 4 == 0 else "JUNK") for i in range(n)]


def test_statistics_of_running_jobs_equal_those_of_the_batch(spark):
    rows = pages(400, 3)
    whole = spark.createDataFrame(rows, running.REQUESTED)
    want = sorted(map(tuple, J.batch_stats(whole, 30).collect()))
    root = work_folder(spark, "test-running")
    parts = [[r for r in rows if r[2] * 5 // 400 == k] for k in range(5)]
    stream = stream_of(spark, f"{root}/in", [spark.createDataFrame(p, running.REQUESTED) for p in parts])
    running.run_job_statistics(stream, f"{root}/out", 30, late="210 seconds").awaitTermination()
    got = running.read_job_statistics(spark, f"{root}/out", 30).collect()
    assert sorted(tuple(r)[:-1] for r in got) == want
    last = max(r[1] for r in rows if r[1]) - timedelta(seconds=210)
    for job in ("hot", "j"):
        final = sum(r[1] is None or r[1] <= last for r in rows if r[0] == job)
        assert {r["batch"]: r["complete"] for r in got if r["job_id"] == job} == {
            b: (b + 1) * 30 <= final for b in range((sum(r[0] == job for r in rows) + 29) // 30)}
    # Tables of earlier batches are gone, but for the last two.
    assert last_committed(spark, f"{root}/out") == 4
    assert [path_exists(spark, f"{root}/out/carry/batch={k}") for k in range(5)] == [False, False, False, True, True]


def test_pages_later_than_allowed_are_counted_and_none_twice(spark):
    rows = pages(120, 4)
    root = work_folder(spark, "test-late")
    early = [r for r in rows if r[2] % 2]
    late = [r for r in rows if not r[2] % 2]
    first = stream_of(spark, f"{root}/in", [spark.createDataFrame(early, running.REQUESTED)])
    running.run_job_statistics(first, f"{root}/out", 10).awaitTermination()
    second = stream_of(spark, f"{root}/in", [spark.createDataFrame(late, running.REQUESTED)])
    for _ in range(2):  # a second run finds nothing new
        running.run_job_statistics(second, f"{root}/out", 10).awaitTermination()
    got = running.read_job_statistics(spark, f"{root}/out", 10)
    assert got.agg(F.sum("pages")).first()[0] == 120 and got.where("NOT complete").count() == 2
    last = got.groupBy("job_id").agg(F.max("requests_so_far").alias("n")).collect()
    assert {r["job_id"]: r["n"] for r in last} == {j: sum(r[3] for r in rows if r[0] == j) for j in ("hot", "j")}


def test_unpublished_statistics_are_not_read(spark):
    root = work_folder(spark, "test-half")
    assert running.read_job_statistics(spark, root, 10).count() == 0
    spark.createDataFrame([("j", 0, 5, 5, 5, 5)], running._COUNTS).write.parquet(f"{root}/counts/batch=0")
    spark.createDataFrame([], running._CARRY).write.parquet(f"{root}/carry/batch=0")
    spark.createDataFrame([], running.REQUESTED).write.parquet(f"{root}/waiting/batch=0")
    assert running.read_job_statistics(spark, root, 10).count() == 0
    commit_batch(spark, root, 0)
    assert [r["pages"] for r in running.read_job_statistics(spark, root, 10).collect()] == [5]


def test_offers_leave_the_stream_once_and_state_is_bounded(spark):
    root = work_folder(spark, "test-once")
    schema = "currency string, nominal_value decimal(18,2), retrieved_time timestamp, url string, site string, delivered_at timestamp"

    def delivered(day, urls):
        rows = [("RON", 5, T0 - timedelta(900) if u != "null" else None, u if u != "nourl" else None, "s", T0 + timedelta(days=day)) for u in urls]
        return spark.createDataFrame([(c, None, t, u, s, d) for c, _, t, u, s, d in rows], schema)

    days = [delivered(0, ["a", "b", "a", "null", "nourl"]), delivered(0, ["a", "null", "nourl", "c"]), delivered(1, ["b", "c"]),
            delivered(9, ["d"]), delivered(10, ["d"]), delivered(11, ["a"])]
    stream = S.stream_distinct_offers(stream_of(spark, f"{root}/in", days), "delivered_at", within="2 days")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").option(
        "path", f"{root}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/out").groupBy("url").count().collect()
    # a comes again long after its first delivery and leaves again; the state no longer holds it.
    assert {r["url"]: r["count"] for r in got} == {"a": 2, "b": 1, "c": 1, "d": 1, "null": 1, None: 1}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) == 6 and states[-1] <= 2


def test_keys_share_state_and_expire_each_at_its_own_time(spark):
    """Many keys in few groups give what a row-by-row run over the batches gives, with few entries in the state."""
    r, ttl, late = random.Random(11), timedelta(days=10), timedelta(days=2)
    days = [[(r.choice([None, *"abcdefghijklmnop"]), r.choice([d, d, d - 1, d - 5]) if d else 0, float(r.randint(1, 9)),
              r.choice([None, *range(5)])) for _ in range(30)] for d in (0, 1, 4, 4, 11, 13, 30, 31)]
    held, want, seen, before = {}, [], None, None  # the engine drops rows by the watermark of the batch before
    for batch, rows in enumerate([*days, []]):
        mark = None if seen is None else seen - late
        new = {}
        for isbn, day, value, page in rows:
            t = T0 + timedelta(days=day, microseconds=7)
            if before is None or t > before:
                rank = (t, page is not None, page or 0, f"u{page}")
                new[isbn] = max(rank, new.get(isbn, rank))
        new = {isbn: rank for isbn, rank in new.items() if isbn not in held or rank > held[isbn]}
        want += [(batch, isbn, rank[0], rank[3], False) for isbn, rank in new.items()]
        held |= new
        over = [isbn for isbn, rank in held.items() if mark is not None and rank[0] - timedelta(microseconds=7) + ttl <= mark]
        want += [(batch, isbn, held[isbn][0], held[isbn][3], True) for isbn in over]
        for isbn in over:
            del held[isbn]
        before, seen = mark, max([T0 + timedelta(days=d) for _, d, _, _ in rows] + ([] if seen is None else [seen]))
    root = work_folder(spark, "test-groups")
    changes = expiry.stream_current_offers(stream_of(spark, f"{root}/in", [offer(spark, d) for d in days]), "isbn",
                                           ttl="10 days", late="2 days", groups=3)
    with rocksdb_state(spark):
        q = changes.writeStream.foreachBatch(lambda b, k: b.write.parquet(f"{root}/out/batch={k}")).option(
            "checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(x["batch"], x["isbn"], x["best_offer"]["retrieved_time"], x["best_offer"]["url"], x["expired"])
           for x in spark.read.parquet(f"{root}/out").collect()]
    assert {*got} ^ {*want} == set() and len(got) == len(want) and any(x[-1] for x in want)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3


def test_offers_that_a_later_one_makes_void_do_not_move(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(expiry, "HELD", 8)
    rows = [("a", 1), ("b", 5), (None, 2), ("a", 3), ("a", 3), ("b", 4), (None, 1)] * 3
    columns = pa.schema({"latest_key": pa.string(), "latest_us": pa.int64(), "x": pa.int64()})
    parts = [pa.RecordBatch.from_pylist([{"latest_key": k, "latest_us": t, "x": n + i} for i, (k, t) in enumerate(rows[n:n + 4])], columns)
             for n in range(0, len(rows), 4)]
    left = [(x["latest_key"], x["latest_us"], x["x"]) for b in expiry.latest_of_task(iter(parts)) for x in b.to_pylist()]
    assert sorted(map(repr, left)) == sorted(repr((k, t, n)) for n, (k, t) in enumerate(rows) if t == {"a": 3, "b": 5, None: 2}[k])
    many = pa.RecordBatch.from_pylist([{"latest_key": str(i), "latest_us": i} for i in range(20)])
    assert sum(b.num_rows for b in expiry.latest_of_task(iter([many, many.slice(0, 0), many]))) >= 20
    assert list(expiry.latest_of_task(iter([]))) == []


def test_deliveries_are_sorted_and_leave_once(spark, tmp_path, monkeypatch):
    from shopcat.plans import queries as Q

    lines = spark.range(400).selectExpr(
        "id * 7919 % 400 AS l_orderkey", "id % 9 AS l_partkey", "id % 5 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "double(id % 50) AS l_quantity", "double(id) + 0.25 AS l_extendedprice", "'N' AS l_returnflag", "'O' AS l_linestatus",
        "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    folders = {}
    monkeypatch.setattr(Q, "work_folder", lambda s, name: folders.setdefault(name, str(tmp_path / name)))
    assert Q.QUERIES["stream_distinct_offers"](spark, str(tmp_path)).select("url").distinct().count() == 400
    delivered = spark.read.parquet(folders["delivered"]).selectExpr("url", "delivered_at", "_metadata.file_path AS f")
    assert [r["count"] for r in delivered.groupBy("delivered_at").count().collect()] == [400] * 3
    files = delivered.groupBy("f").agg(F.collect_list("url").alias("u")).collect()
    assert all(r["u"] == sorted(r["u"]) for r in files)

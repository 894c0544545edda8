"""Frontier, jobs, statistics, tables, and streams against their batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shopcat.operators import jobs as J
from shopcat.operators import pages as P
from shopcat.operators.catalog import observations, merge_books, offer_rows, find_offers
from shopcat.operators.extract import scrape
from shopcat.plans.queries import QUERIES
from shopcat.schemas import FETCH_ATTEMPTS, FRONTIER, JOBS, RAW_PAGES
from shopcat.session import work_folder
from shopcat.sources import rendered as R
from shopcat.sources.tables import commit_batch, read_pages, stream_pages, write_books, write_offers
from shopcat.streaming import streams as S

T0 = datetime(2024, 1, 1)
PART = "/root/testdata/sf0.001/part.parquet"


def test_fetch_fold(spark):
    rows = [("j", "a", 0, False, 1), ("j", "a", 1, True, 1), ("j", "b", 0, False, 1), ("j", "b", 1, False, 1),
            ("j", "b", 2, True, 1), ("j", "c", 0, True, 1)]
    got = P.fold_fetches(spark.createDataFrame(rows, FETCH_ATTEMPTS)).orderBy("url").collect()
    assert [(r["url"], r["reached"], r["attempts"]) for r in got] == [("a", True, 2), ("b", False, 2), ("c", True, 1)]


def test_classify(spark):
    rows = [(1, True, "1", 5), (2, True, None, 5), (3, True, "", None), (4, False, "1", 5), (5, None, None, None)]
    got = P.classify(spark.createDataFrame(rows, "i int, reached boolean, isbn string, offer int")).orderBy("i")
    assert [r["type"] for r in got.collect()] == ["PRODUCT", "JUNK", "UNAVAILABLE", "UNREACHABLE", "UNREACHABLE"]


def frontier(spark, rows):
    return spark.createDataFrame(rows, FRONTIER)


def test_frontier_select_and_upsert(spark):
    f = frontier(spark, [
        ("u1", "d", None, "t", "PRODUCT", T0, "j0"), ("u2", "d", None, "t", "JUNK", T0, "j0"),
        ("u3", "d", None, None, None, None, None), ("u4", "d", None, "t", "PRODUCT", T0, "j1"),
        ("u5", "e", None, None, None, None, None)])
    assert [r["url"] for r in P.select_frontier(f, "d", "j1").collect()] == ["u3", "u1"]
    later = [("u1", "d", None, None, "UNREACHABLE", None, None, T0 + timedelta(hours=2)),
             ("u1", "d", "c1", "new", "UNAVAILABLE", T0 + timedelta(hours=1), "j1", T0 + timedelta(hours=1)),
             ("u9", "d", None, None, "UNREACHABLE", None, None, T0)]
    scraped = spark.createDataFrame(later, FRONTIER + ", seen_at timestamp")
    got = {r["url"]: (r["type"], r["title"], r["last_job"]) for r in P.upsert_frontier(f, scraped).collect()}
    assert got["u1"] == ("UNREACHABLE", "new", "j1") and got["u2"] == ("JUNK", "t", "j0")
    assert got["u9"] == ("UNREACHABLE", None, None) and len(got) == 6


def test_next_pages_of_every_domain(spark):
    r = random.Random(3)
    rows = [(f"u{i:04}", "hot" if i % 3 == 0 else r.choice(["a", "b", None]), None, None,
             r.choice([None, "PRODUCT", "JUNK"]), r.choice([None, T0, T0 + timedelta(hours=r.randrange(99))]),
             r.choice([None, "j1", "j2"])) for i in range(900)]
    running = {("hot", "j1"), ("a", "j2"), ("a", "j1"), (None, "j2"), ("idle", "j3")}
    for held in (running, None):
        marks = None if held is None else spark.createDataFrame(list(held), "domain string, job_id string")
        want = {}
        for row in rows:
            if row[4] != "JUNK" and (row[1], row[6]) not in (held or ()):
                want.setdefault(row[1], []).append(row)
        want = {d: [x[0] for x in sorted(own, key=lambda x: (x[5] is not None, x[5] or T0, x[0]))[:7]] for d, own in want.items()}
        for salts in (1, 64):
            got = {}
            for x in P.next_pages(frontier(spark, rows), 7, marks, salts).orderBy("place").collect():
                got.setdefault(x["domain"], []).append(x["url"])
            assert got == want
    plan = P.next_pages(frontier(spark, rows), 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "rangepartitioning" not in plan
    assert P.next_pages(frontier(spark, []), 7).count() == 0


def jobs(spark):
    return spark.createDataFrame([
        ("j1", "a.ro", "SCRAPE", "ACTIVE", T0, None), ("j2", "b.ro", "SCRAPE", "FINISHED", T0, T0),
        ("j3", "c.ro", "CRAWL", "ACTIVE", T0, None)], JOBS)


def test_jobs(spark):
    assert [r["job_id"] for r in J.active_jobs(jobs(spark)).collect()] == ["j1"]
    assert [r["total_ms"] for r in J.job_durations(jobs(spark)).orderBy("job_id").collect()] == [None, 0, None]
    assert J.job_by_id(jobs(spark), "j2").first()["domain"] == "b.ro"
    closing = spark.createDataFrame([("j1", T0), ("j1", T0 + timedelta(days=1))], "job_id string, closed_at timestamp")
    closed = {r["job_id"]: (r["status"], r["end"]) for r in J.close_jobs(jobs(spark), closing).collect()}
    assert closed == {"j1": ("FINISHED", T0 + timedelta(days=1)), "j2": ("FINISHED", T0), "j3": ("ACTIVE", None)}


def test_triage(spark):
    bodies = ['{"homepage":"https://www.a.ro/"}', '{"homepage":7}', '{}', 'x', None, '{"homepage":"nohost"}',
              '{"homepage":"https://c.ro"}', '{"homepage":"http://C.ro/x"}',
              '{"homepage":"https://d.ro","continue":"0123456789abcdefABCDEF00"}',
              '{"homepage":"https://e.ro","continue":"old"}', '{"homepage":"https://e.ro","continue":5}']
    requests = spark.createDataFrame([(i, b, T0 + timedelta(seconds=i)) for i, b in enumerate(bodies)],
                                     "request_id bigint, body string, requested_at timestamp")
    got = J.triage_requests(requests, jobs(spark)).orderBy("request_id").collect()
    assert [(r["status"], r["job_id"]) for r in got] == [
        (409, "j1"), (400, None), (400, None), (400, None), (400, None), (400, None), (202, "6"), (409, "6"),
        (202, "0123456789abcdefABCDEF00"), (400, None), (400, None)]


def test_statistics(spark):
    attempts = spark.createDataFrame([("j", "d", "a", False), ("j", "d", "a", True), ("j", "d", "b", False)],
                                     "job_id string, domain string, url string, ok boolean")
    scraped = spark.createDataFrame([("j", "d", "PRODUCT"), ("j", "d", "JUNK")], "job_id string, domain string, type string")
    r = J.job_stats(attempts, scraped).first()
    assert (r["pages_requested"], r["requests"], r["pages_reached"], r["pairs_found"]) == (2, 3, 1, 1)
    late = spark.createDataFrame([("k", "d", "PRODUCT")], "job_id string, domain string, type string")
    only_scraped = J.job_stats(attempts, late).where("job_id = 'k'").first()
    assert (only_scraped["pages_requested"], only_scraped["pairs_found"]) == (0, 1)
    timings = spark.createDataFrame([("j", "d", False, False, 10, 0, 0, 0)], "job_id string, domain string, reached boolean, "
                                    "paired boolean, download_ms bigint, processing_ms bigint, crawl_persist_ms bigint, product_persist_ms bigint")
    r = J.job_timings(timings).first()
    assert r["download_mean_ms"] == 10.0 and r["processing_mean_ms"] is None and r["product_persist_mean_ms"] is None


def test_batches_equal_plain_numbering(spark):
    r = random.Random(1)
    # one job owns most pages, many at the same second
    rows = [("hot" if r.random() < .7 else "j", None if i < 20 else T0 + timedelta(seconds=r.randint(0, 300)), i, 1 + i % 2, i % 3 > 0,
             "PRODUCT" if i % 4 == 0 else "JUNK") for i in range(400)]
    df = spark.createDataFrame(rows, "job_id string, requested_at timestamp, page_id bigint, attempts int, reached boolean, type string")
    got = {(x["job_id"], x["batch"]): (x["pages"], x["requests_so_far"], x["reached_so_far"], x["pairs_so_far"])
           for x in J.batch_stats(df, 50).collect()}
    want = {}
    for job in ("hot", "j"):
        mine = sorted((x for x in rows if x[0] == job), key=lambda x: (x[1] or datetime.min, x[2]))
        for b in range(0, (len(mine) + 49) // 50):
            seen = mine[: (b + 1) * 50]
            want[job, b] = (len(mine[b * 50:(b + 1) * 50]), sum(x[3] for x in seen), sum(x[4] for x in seen),
                            sum(x[5] == "PRODUCT" for x in seen))
    assert got == want


def write_pages(spark, folder, slices):
    pages = R.render_shop_pages(spark.read.parquet(PART))
    for i in range(slices):
        pages.filter(F.col("page_id") % slices == i).coalesce(1).write.mode("append").parquet(folder)
    return pages


def test_stream_catalog_equals_batch(spark):
    root = work_folder(spark, "test-stream")
    pages = write_pages(spark, f"{root}/pages", 2)
    wrappers = R.wrappers(spark.read.parquet(PART))
    for _ in range(2):  # a second run finds nothing new
        S.run_catalog_stream(stream_pages(spark, f"{root}/pages", max_files=1), f"{root}/cat", "job", wrappers).awaitTermination()
    observations(P.classify(scrape(pages, wrappers))).write.parquet(f"{root}/found")
    found = spark.read.parquet(f"{root}/found")
    columns = ["isbn", "title", "authors", "publisher", "format", "keywords", "best_offer", "isbns", "book_id"]

    def rows(df):
        return sorted(map(repr, df.select(*columns).collect()))

    assert rows(S.read_books(spark, f"{root}/cat")) == rows(merge_books(found))
    offers = S.read_offers(spark, f"{root}/cat")
    assert sorted(r[0] for r in offers.select("offer_id").collect()) == sorted(
        r[0] for r in offer_rows(found).select("offer_id").collect())
    one_site = find_offers(offers, "shop2.example.ro")
    assert "PushedFilters: [IsNotNull(site), EqualTo(site,shop2.example.ro)" in one_site._jdf.queryExecution().toString()
    f = S.read_frontier(spark, f"{root}/cat")
    assert f.count() == 200 and f.filter("last_job = 'job' and title is not null").count() == 200
    S.compact(spark, f"{root}/cat", f"{root}/compact")
    assert rows(S.read_books(spark, f"{root}/compact")) == rows(merge_books(found))
    assert S.read_frontier(spark, f"{root}/compact").count() == 200


def test_stream_best_offer_equals_batch(spark):
    root = work_folder(spark, "test-offers")
    pages = write_pages(spark, f"{root}/pages", 2)

    def offers(df):
        return scrape(df).select("site", "offer", F.struct("page_id", "url").alias("seq"))

    out = S.stream_best_offer(offers(stream_pages(spark, f"{root}/pages", max_files=1)), "site")
    out.writeStream.outputMode("complete").format("memory").queryName("best").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    from shopcat.operators.catalog import best_offer

    assert sorted(map(repr, spark.table("best").collect())) == sorted(map(repr, best_offer(offers(pages), "site").collect()))


def test_read_pages_without_time(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    assert pages.columns == ["page_id", "url", "html", "retrieved_time"] and pages.filter("retrieved_time is null").count() == 50


def test_tables_are_empty_before_and_after_a_crawl_without_products(spark):
    root = work_folder(spark, "test-empty")
    assert S.read_books(spark, root).count() == S.read_offers(spark, root).count() == S.read_frontier(spark, root).count() == 0
    spark.createDataFrame([(1, "https://a.ro/1", "<p>no product</p>", T0)], RAW_PAGES).write.parquet(f"{root}/pages")
    S.run_catalog_stream(stream_pages(spark, f"{root}/pages"), f"{root}/cat", "job").awaitTermination()
    assert S.read_books(spark, f"{root}/cat").count() == S.read_offers(spark, f"{root}/cat").count() == 0
    assert S.read_frontier(spark, f"{root}/cat").count() == 1


def test_readers_see_a_batch_in_all_tables_or_in_none(spark):
    root = work_folder(spark, "test-crash")
    rows = P.classify(scrape(R.render_shop_pages(spark.read.parquet(PART).limit(30))))
    rows.write.parquet(f"{root}/scraped")
    found = observations(spark.read.parquet(f"{root}/scraped"))
    write_offers(offer_rows(found, "job"), f"{root}/offers", 0)  # the job dies before books are written
    assert S.read_offers(spark, root).count() == 0 and S.read_books(spark, root).count() == 0
    for _ in range(2):  # the batch is tried again, and once more delivered under another number
        write_offers(offer_rows(found, "job"), f"{root}/offers", 0)
        write_books(merge_books(found), f"{root}/books", 0)
    write_offers(offer_rows(found, "job"), f"{root}/offers", 1)
    write_books(merge_books(found), f"{root}/books", 1)
    commit_batch(spark, root, 0)
    once = (S.read_offers(spark, root).count(), S.read_books(spark, root).count())
    commit_batch(spark, root, 1)
    assert once == (S.read_offers(spark, root).count(), S.read_books(spark, root).count()) == (found.count(), merge_books(found).count())


def test_stream_queries_read_folders_of_part_files(spark):
    sf = work_folder(spark, "test-folders")
    for name, files in (("part", 3), ("lineitem", 4)):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(files).write.parquet(f"{sf}/{name}.parquet")
    for name in ("stream_page_types", "stream_best_offer", "stream_catalog"):
        got = sorted(map(repr, QUERIES[name](spark, sf).collect()))
        assert got == sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))

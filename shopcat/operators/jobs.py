"""The job ledger: active jobs, request triage, closing, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcat.functions.text import site_of
from shopcat.functions.words import ACTIVE, FINISHED, PRODUCT, SCRAPE
from shopcat.session import work_folder

BATCH_SIZE = 10_000
JOB_ID = "^[0-9a-fA-F]{24}$"  # of a job that a request wants to continue


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs of type SCRAPE that are active."""
    return jobs.filter((F.col("type") == SCRAPE) & (F.col("status") == ACTIVE))


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def close_jobs(jobs: DataFrame, closing: DataFrame) -> DataFrame:
    """Stamp FINISHED and the end time on the jobs named in ``closing(job_id, closed_at)``."""
    ends = closing.groupBy("job_id").agg(F.max("closed_at").alias("_end"))
    return jobs.join(ends, "job_id", "left").withColumns({
        "status": F.when(F.col("_end").isNotNull(), FINISHED).otherwise(F.col("status")),
        "end": F.coalesce("_end", "end"),
    }).drop("_end")


def job_durations(jobs: DataFrame) -> DataFrame:
    """Total duration of every job in milliseconds, null while it runs."""
    return jobs.select(
        "job_id", "domain", (F.unix_millis("end") - F.unix_millis("start")).alias("total_ms"))


def triage_requests(requests: DataFrame, jobs: DataFrame, id_pattern: str = JOB_ID) -> DataFrame:
    """Answer scrape requests ``(request_id, body, requested_at)``: ``status, site, job_id``.

    400: the body has no textual ``homepage``, its url has no host, or ``continue`` is there and no text
    that matches ``id_pattern``. 409: the site has an active job, or an earlier request of this table
    started one; ``job_id`` names that job. 202: started; ``job_id`` is the ``continue`` id or the
    request's own. The winner per site is an aggregate, and the lookup an equi-join that AQE
    broadcasts or splits, so one busy site does not fill one task.
    """
    body = F.try_parse_json("body")

    def member(name: str) -> Column:
        return F.try_variant_get(body, f"$.{name}", "variant")

    def text(name: str) -> Column:
        return F.when(F.schema_of_variant(member(name)) == "STRING",
                      F.try_variant_get(body, f"$.{name}", "string"))

    continued = text("continue")
    fine = member("continue").isNull() | F.coalesce(continued.rlike(id_pattern), F.lit(False))
    asked = requests.select(
        "request_id", "requested_at",
        F.when(fine, site_of(text("homepage"))).alias("site"), continued.alias("continued"))
    active = active_jobs(jobs).groupBy(F.col("domain").alias("site")).agg(
        F.min("job_id").alias("active_job"))
    first = asked.filter(F.col("site").isNotNull()).groupBy("site").agg(
        F.min(F.struct("requested_at", "request_id",
                       F.coalesce("continued", F.col("request_id").cast("string")).alias("job_id")))
        .alias("first"))
    known = first.join(active, "site", "left")
    answered = asked.join(known, "site", "left")
    blocked = F.col("active_job").isNotNull()
    won = F.col("first.request_id") == F.col("request_id")
    return answered.select(
        "request_id", "site",
        F.when(F.col("site").isNull(), 400).when(blocked | ~won, 409).otherwise(202).alias("status"),
        F.when(F.col("site").isNotNull(), F.coalesce("active_job", "first.job_id")).alias("job_id"),
    )


def job_stats(attempts: DataFrame, scraped: DataFrame) -> DataFrame:
    """Per job and domain: pages requested, attempts made, pages reached, product-offer pairs.

    ``attempts(job_id, domain, url, ok)``, ``scraped(job_id, domain, type)``. Attempts are folded
    per page first, so a job that owns a third of the rows is spread over its pages.
    """
    per_page = attempts.groupBy("job_id", "domain", "url").agg(
        F.count("*").alias("n"), F.bool_or("ok").alias("ok"))
    fetched = per_page.groupBy("job_id", "domain").agg(
        F.count("*").alias("pages_requested"), F.sum("n").alias("requests"),
        F.count_if("ok").alias("pages_reached"))
    pairs = scraped.groupBy("job_id", "domain").agg(
        F.count_if(F.col("type") == PRODUCT).alias("pairs_found"))
    counters = ["pages_requested", "requests", "pages_reached", "pairs_found"]
    return fetched.join(pairs, ["job_id", "domain"], "full").fillna(0, counters)


def job_timings(timings: DataFrame) -> DataFrame:
    """Totals and per-page means of a job's durations; a mean is null when its divisor is 0.

    ``timings(job_id, domain, reached, paired, download_ms, processing_ms, crawl_persist_ms,
    product_persist_ms)``, one row per requested page. Download is per requested page, processing
    and crawl persistence per reached page, product persistence per product-offer pair.
    """
    names = ("download", "processing", "crawl_persist", "product_persist")
    totals = timings.groupBy("job_id", "domain").agg(
        F.count("*").alias("_download"),
        F.count_if("reached").alias("_processing"),
        F.count_if("paired").alias("_product_persist"),
        *[F.sum(f"{n}_ms").alias(f"{n}_total_ms") for n in names],
    ).withColumn("_crawl_persist", F.col("_processing"))
    return totals.select(
        "job_id", "domain", *[f"{n}_total_ms" for n in names],
        *[F.try_divide(F.col(f"{n}_total_ms").cast("double"), F.col(f"_{n}")).alias(f"{n}_mean_ms")
          for n in names],
    )


def number_pages(requested: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Add ``number``, a page's place within its job from 0, by time and page; pages without a time come first.

    Pages are sorted by a range shuffle, which splits a job of any size; a page's number is its place in its
    partition plus the job's pages in earlier partitions. That is one row per job and partition. ``before(job_id,
    pages)`` tells how many pages of a job were numbered already.
    """
    spark = requested.sparkSession
    order = ("job_id", "requested_at", "page_id")
    path = work_folder(spark, "requested")
    requested.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("job_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_pages"))
    earlier = Window.partitionBy("job_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "job_id", "_part", (F.coalesce(F.sum("_pages").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    if before is not None:
        known = before.select("job_id", F.col("pages").alias("_before"))
        offsets = offsets.join(known, "job_id", "left").select(
            "job_id", "_part", (F.col("_shift") + F.coalesce("_before", F.lit(0))).alias("_shift"))
    return rows.join(offsets, ["job_id", "_part"]).withColumn("number", F.col("_at") + F.col("_shift"))


def count_pages(numbered: DataFrame, n: int = BATCH_SIZE) -> DataFrame:
    """Pages, requests, pages reached and pairs found of every ``n`` pages of a job in a row."""
    return numbered.groupBy("job_id", F.floor(F.col("number") / n).cast("int").alias("batch")).agg(
        F.count("*").alias("pages"), F.sum("attempts").alias("requests"),
        F.count_if("reached").alias("reached"),
        F.count_if(F.col("type") == PRODUCT).alias("pairs"),
    )


def running_counts(counted: DataFrame, *more: Column) -> DataFrame:
    """The counts of :func:`count_pages` added up over a job's batches, with ``more`` columns."""
    running = Window.partitionBy("job_id").orderBy("batch").rowsBetween(
        Window.unboundedPreceding, 0)
    return counted.select(
        "job_id", "batch", "pages",
        *[F.sum(c).over(running).alias(f"{c}_so_far") for c in ("pages", "requests", "reached", "pairs")], *more)


def batch_stats(requested: DataFrame, n: int = BATCH_SIZE) -> DataFrame:
    """Running counters of a job after every ``n`` requested pages.

    ``requested(job_id, requested_at, page_id, attempts, reached, type)``, one row per page.
    """
    return running_counts(count_pages(number_pages(requested), n))

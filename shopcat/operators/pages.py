"""The crawl frontier: fetch outcomes, page types, selection and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcat.functions.words import JUNK, PRODUCT, UNAVAILABLE, UNREACHABLE


def fold_fetches(attempts: DataFrame, max_tries: int = 2) -> DataFrame:
    """Per job and url: was it reached within ``max_tries`` attempts, and how many were made."""
    return attempts.filter(F.col("attempt") < max_tries).groupBy("job_id", "url").agg(
        F.bool_or("ok").alias("reached"), F.count("*").alias("attempts"))


def classify(pages: DataFrame) -> DataFrame:
    """Add ``type``. An unreached page has ``reached`` false or, without that column, no title.

    A book needs an ISBN (an empty one counts); without a book the page is JUNK, without an offer
    UNAVAILABLE.
    """
    reached = F.col("reached") if "reached" in pages.columns else F.col("page_title").isNotNull()
    return pages.withColumn(
        "type",
        F.when(~F.coalesce(reached, F.lit(False)), UNREACHABLE)
        .when(F.col("isbn").isNull(), JUNK)
        .when(F.col("offer").isNull(), UNAVAILABLE)
        .otherwise(PRODUCT),
    )


def select_frontier(frontier: DataFrame, domain: str, job_id: str) -> DataFrame:
    """Candidate pages of a domain, oldest first, without junk and what this job has handled."""
    return frontier.filter(
        (F.col("domain") == domain)
        & (F.col("type").isNull() | (F.col("type") != JUNK))
        & (F.col("last_job").isNull() | (F.col("last_job") != job_id))
    ).orderBy(F.asc_nulls_first("retrieved_time"), "url")


def next_pages(frontier: DataFrame, n: int, jobs: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """The next ``n`` candidates of every domain, oldest first, with their ``place`` from 1.

    Junk is left out, and pages that a running job of their domain has handled: ``jobs`` (domain, job_id).
    Nothing is sorted as a whole. A domain is dealt over ``salts`` groups by its urls, each group keeps its first n
    rows, and only those meet; Spark cuts to n rows per group before the shuffle too (for n of up to 1000, the
    threshold of its limit below windows). So a domain that owns most pages is spread over tasks, and one task holds
    at most ``n * salts`` rows of it. Null domains are a domain of their own.
    """
    open_pages = frontier.filter(F.col("type").isNull() | (F.col("type") != JUNK))
    if jobs is not None:
        running = jobs.select(F.col("domain").alias("_domain"), F.col("job_id").alias("_job"))
        open_pages = open_pages.join(
            running, F.col("domain").eqNullSafe(F.col("_domain")) & (F.col("last_job") == F.col("_job")), "left_anti")
    order = (F.asc_nulls_first("retrieved_time"), "url")
    dealt = open_pages.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)))
    for group in (("domain", "_salt"), ("domain",)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= n)
    return dealt.drop("_salt")


def frontier_rows(scraped: DataFrame, job_id: str) -> DataFrame:
    """Frontier rows of scraped pages. An unreachable page carries only its type."""
    reached = F.col("type") != UNREACHABLE
    return scraped.select(
        "url",
        F.col("site").alias("domain"),
        *[F.when(reached, F.col(c)).alias(n) for c, n in (
            ("canonical_url", "canonical_url"), ("page_title", "title"))],
        "type",
        F.when(reached, F.col("retrieved_time")).alias("retrieved_time"),
        F.when(reached, F.lit(job_id)).alias("last_job"),
        F.col("retrieved_time").alias("seen_at"),
    )


def upsert_frontier(frontier: DataFrame, scraped: DataFrame) -> DataFrame:
    """Latest state per url. ``scraped`` has the frontier's columns and ``seen_at``.

    The type comes from the latest row, everything else from the latest row that was reached, so
    an unreachable page keeps what was known. The time decides what is latest, whatever arrives first;
    of equal times the scraped row wins. A hot url is reduced before the shuffle.
    """
    kept = ("canonical_url", "title", "retrieved_time", "last_job")
    stored = frontier.withColumns({
        "_rank": F.lit(0),
        "seen_at": F.col("seen_at") if "seen_at" in frontier.columns else F.col("retrieved_time"),
    })
    rows = stored.unionByName(scraped.withColumn("_rank", F.lit(1)))
    order = F.struct("seen_at", "_rank", *kept, "type").alias("order")
    latest = F.struct(order, F.col("type").alias("type"), F.col("domain").alias("domain"))
    # A row that was never fetched has no type yet, and an unreachable one stamped nothing.
    stamped = F.when(
        F.col("type").isNull() | (F.col("type") != UNREACHABLE) | (F.col("_rank") == 0),
        F.struct(order, *kept))
    return rows.groupBy("url").agg(F.max(latest).alias("l"), F.max(stamped).alias("r")).select(
        "url", "l.domain", *[F.col(f"r.{c}").alias(c) for c in ("canonical_url", "title")],
        "l.type", *[F.col(f"r.{c}").alias(c) for c in ("retrieved_time", "last_job")],
        F.col("l.order.seen_at").alias("seen_at"))

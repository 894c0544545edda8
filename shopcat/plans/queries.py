"""The registered queries: each runs one or more operators over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcat.functions import fields as X
from shopcat.functions.isbn import coerce_isbn, isbn_candidates, normalise_isbn
from shopcat.functions.nodes import canonical_url, document_title, main_text
from shopcat.functions.price import coerce_availability, price_value
from shopcat.functions.text import site_of
from shopcat.operators import catalog as C
from shopcat.operators import jobs as J
from shopcat.operators import pages as P
from shopcat.operators.extract import heuristic_books, scrape, wrapper_books
from shopcat.operators.induction import induce_selectors, label_nodes
from shopcat.schemas import BOOKS, OFFERS, RAW_PAGES
from shopcat.session import tune, work_folder
from shopcat.sources import rendered as R
from shopcat.sources import snapshots
from shopcat.sources.encoded import decode_pages
from shopcat.sources.html import with_nodes
from shopcat.sources.wrappers import publish_wrappers, read_wrappers
from shopcat.sources.tables import (
    commit_batch, is_folder, read_batches, read_pages, spread, stream_pages, write_books, write_frontier, write_offers,
)
from shopcat.streaming import expiry, running
from shopcat.streaming import streams as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BATCH = 500
TTL, LATE = "45 days 1 hour", "2 days"  # of a current offer
NEXT = 40  # pages of a domain
KEYWORD = "gizmo"
SITE = "s7.example.ro"
JOB = "j7"
LOOKUPS = {"title": "T7", "authors": "Aaa", "isbn": "9780000000071", "best_offer_site": SITE}


def query(f: Query) -> Query:
    """Register ``f``; its session gets the settings that the operators need."""
    @wraps(f)
    def tuned(spark: SparkSession, sf: str) -> DataFrame:
        tune(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = tuned
    return tuned


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts))


def utc(ts: str) -> Column:
    return F.timestamp_micros(micros(ts))


def joined(c: str) -> Column:
    return F.array_join(c, " ")


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    return R.render_shop_pages(spread(table(spark, sf, "part")))


def given_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_pages(spark, f"{sf}/pages.parquet"))


def double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# --- pages and fields ----------------------------------------------------------------------------

@query
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    nodes = with_nodes(given_pages(spark, sf))
    return nodes.select("page_id", X.title(F.col("nodes"), F.col("page_text")).alias("title"),
                        document_title(F.col("nodes"), F.col("page_text")).alias("page_title"))


@query
def page_site(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", site_of(F.col("url")).alias("site"))


@query
def url_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of addresses as crawls meet them: bars, spaces, underscores, ports, no scheme."""
    k = F.col("p_partkey").cast("string")
    shop = (F.col("p_partkey") % 5).cast("string")
    kind = F.col("p_partkey") % 7
    url = (
        F.when(kind == 0, F.concat(F.lit("https://www.My_Shop"), shop, F.lit(".ro/x|y/"), k))
        .when(kind == 1, F.concat(F.lit("https://shop"), shop, F.lit(".example.ro/a b {"), k, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("HTTP://u:p@Shop"), shop, F.lit(".example.ro:8080?q="), k))
        .when(kind == 3, F.concat(F.lit("https://[2001:db8::1]/"), k))
        .when(kind == 4, F.concat(F.lit("not a url "), k))
        .when(kind == 5, F.concat(F.lit("//shop.ro/"), k))
        .otherwise(F.concat(F.lit("https://a b.ro/"), k))
    )
    return table(spark, sf, "part").select("p_partkey", site_of(url).alias("site"))


@query
def shop_main_text(spark: SparkSession, sf: str) -> DataFrame:
    nodes = with_nodes(shop_pages(spark, sf))
    return nodes.select("page_id", main_text(F.col("nodes"), F.col("page_text")).alias("main_text"))


@query
def page_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes per page and tag."""
    nodes = with_nodes(given_pages(spark, sf)).select("page_id", F.explode("nodes").alias("node"))
    return nodes.groupBy("page_id", F.col("node.tag").alias("tag")).agg(F.count("*").alias("n"))


@query
def page_main_text(spark: SparkSession, sf: str) -> DataFrame:
    nodes = with_nodes(given_pages(spark, sf))
    return nodes.select("page_id", main_text(F.col("nodes"), F.col("page_text")).alias("main_text"))


@query
def isbn_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", isbn_candidates(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").alias("n"), joined("c").alias("isbns"))


@query
def isbn_coerced(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    isbn = R.isbn13_of(k)
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("ISBN "), R.hyphenated(isbn)))
        .when(k % 5 == 1, F.concat(isbn, F.lit(" ")))
        .when(k % 5 == 2, F.concat(F.lit("cod "), F.substring(isbn, 5, 9), F.lit("X")))
        .when(k % 5 == 3, F.concat(isbn, F.lit(" (pdf)")))
        .otherwise(F.concat(F.lit("ISBN: "), isbn))
    )
    return table(spark, sf, "part").select(
        k, normalise_isbn(coerce_isbn(raw)).alias("isbn"),
        normalise_isbn(coerce_isbn(raw, strict=True)).alias("strict_isbn"))


@query
def shop_books(spark: SparkSession, sf: str) -> DataFrame:
    return heuristic_books(shop_pages(spark, sf)).select(
        "page_id", "title", "authors", "isbn", "description", "image_url", "page_title",
        joined("keywords").alias("keywords"))


@query
def shop_formats(spark: SparkSession, sf: str) -> DataFrame:
    return heuristic_books(shop_pages(spark, sf)).select("page_id", "format")


@query
def shop_publishers(spark: SparkSession, sf: str) -> DataFrame:
    return heuristic_books(shop_pages(spark, sf)).select("page_id", "publisher")


def _offer_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", double("offer.nominal_value").alias("nominal_value"), "offer.currency",
        F.col("offer.url").alias("offer_url"), F.col("offer.site").alias("offer_site"),
        F.col("offer.page_title").alias("offer_title"), "offer.availability",
        F.coalesce(F.unix_micros("offer.retrieved_time"), F.lit(-1)).alias("retrieved_us"))


@query
def shop_offers(spark: SparkSession, sf: str) -> DataFrame:
    return _offer_columns(heuristic_books(shop_pages(spark, sf)))


@query
def stock_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return heuristic_books(shop_pages(spark, sf)).select("page_id", "stock_phrase")


@query
def based_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of shop pages that name another base, on their own or on an image server."""
    k = F.col("page_id")
    base = F.when(k % 3 == 0, F.lit("https://cdn.example.ro/y/z")).when(k % 3 == 1, F.lit("/other/"))
    pages = shop_pages(spark, sf).withColumn("html", F.when(base.isNull(), F.col("html")).otherwise(
        F.replace("html", F.lit("<title>"), F.concat(F.lit("<base href='"), base, F.lit("'><title>")))))
    found = heuristic_books(pages)
    return found.select("page_id", "canonical_url", "image_url")


@query
def encoded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Shop pages fetched as bytes in four charsets, told by mark, header or declaration."""
    k = F.col("page_id")
    letters = F.replace("html", F.lit("Despre "), F.lit("Despre câine înalt, "))
    # The letters added have the same bytes in ISO-8859-1 and ISO-8859-2; other ones are left to Unicode.
    plain = F.translate(letters, "ăĂșȘțȚşŞţŢ", "aAsStTsStT")
    declared = F.replace(plain, F.lit('charset="utf-8"'), F.lit('charset="iso-8859-2"'))
    pages = shop_pages(spark, sf).select(
        "page_id", "url", "retrieved_time",
        F.when(k % 4 == 0, F.encode(letters, "UTF-8")).when(k % 4 == 1, F.encode(letters, "UTF-16"))
        .when(k % 4 == 2, F.encode(plain, "ISO-8859-1")).otherwise(F.encode(declared, "ISO-8859-1")).alias("html"),
        F.when(k % 4 == 2, F.lit("text/html; charset=ISO-8859-1")).alias("content_type"))
    return heuristic_books(decode_pages(pages, "html", "content_type")).select(
        "page_id", "charset", "title", "isbn", "description")


@query
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return with_nodes(shop_pages(spark, sf)).select(
        "page_id", canonical_url(F.col("nodes"), F.col("url")).alias("canonical_url"))


@query
def price_vectors(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", (cents % 100).alias("cents"),
        F.floor(cents / 100).cast("bigint").alias("whole"))
    whole, two = F.col("whole"), F.lpad(F.col("cents").cast("string"), 2, "0")
    thousands = F.floor(whole / 1000).cast("string")
    three = F.lpad((whole % 1000).cast("string"), 3, "0")
    v, lei = F.col("l_linenumber"), F.lit(" lei")
    tag = (
        F.when(v == 1, F.concat(whole, F.lit("."), two, lei))
        .when(v == 2, F.concat(whole, F.lit(","), two, lei))
        .when(v == 3, F.concat(whole, two, F.lit("lei")))
        .when(v == 4, F.concat(thousands, F.lit(","), three, F.lit("."), two, lei))
        .when(v == 5, F.concat(thousands, F.lit("."), three, F.lit(","), two, lei))
        .when(v == 6, F.concat(thousands, F.lit(","), three, lei))
        .otherwise(F.concat(thousands, F.lit("."), three, lei))
    )
    tagged = lines.withColumn("tag", tag)
    return tagged.select(
        "l_orderkey", "tag", double(price_value(F.col("tag"))).alias("value"),
        double(price_value(F.col("tag"), "ceiling")).alias("ceiling_value"))


@query
def availability_map(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary phrases and three that are not in it, padded and in changing case."""
    phrases = R.PHRASES + ("preorder", "in stock", "altceva")
    events = table(spark, sf, "events")
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]),
                          (F.col("event_id") % len(phrases) + 1).cast("int"))
    written = F.when(F.col("user_id") % 2 == 0, F.upper(phrase)).otherwise(phrase)
    return events.select(
        "event_id", coerce_availability(F.concat(F.lit(" "), written, F.lit(" "))).alias("availability"))


# --- selectors -----------------------------------------------------------------------------------

@query
def wrapper_books_query(spark: SparkSession, sf: str) -> DataFrame:
    return wrapper_books(shop_pages(spark, sf), R.wrappers(table(spark, sf, "part"))).select(
        "page_id", "title", "authors", "isbn", "description", "publisher", "format", "image_url")


@query
def wrapper_offers(spark: SparkSession, sf: str) -> DataFrame:
    return _offer_columns(wrapper_books(
        shop_pages(spark, sf), R.wrappers(table(spark, sf, "part")), rounding="ceiling"))


@query
def strategies(spark: SparkSession, sf: str) -> DataFrame:
    scraped = scrape(shop_pages(spark, sf), R.wrappers(table(spark, sf, "part")))
    return scraped.select("page_id", "site", "strategy", "title", "authors", "isbn", "publisher",
                          "format", "image_url",
                          double("offer.nominal_value").alias("nominal_value"), "offer.availability")


def _half(part: DataFrame) -> int:
    return part.agg(F.max("p_partkey")).first()[0] // 2


@query
def wrapper_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Selectors are edited halfway through the crawl; each page is read by those of its time."""
    part = table(spark, sf, "part")
    edited = F.timestamp_seconds(F.lit(R.EPOCH + _half(part)))
    versions = R.wrappers(part).withColumn("valid_from", F.lit(None).cast("timestamp")).union(
        R.edited_wrappers(part).withColumn("valid_from", edited))
    return scrape(shop_pages(spark, sf), versions).select(
        "page_id", "site", "strategy", "title", "authors", "isbn", "publisher",
        double("offer.nominal_value").alias("nominal_value"), "offer.availability")


@query
def selector_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Selectors for labelled nodes of the shop pages, per site and field."""
    pages = with_nodes(shop_pages(spark, sf)).select(
        "page_id", site_of(F.col("url")).alias("domain"), "nodes")
    return induce_selectors(label_nodes(pages, {
        "pricepoint": lambda n: n["class"] == "amount",
        "attributes": lambda n: (n["tag"] == "li")
        & n["own_text"].rlike("^(Editura|ISBN|Format|Autor):"),
        "title": lambda n: n["tag"] == "h1",
    }))


# --- page types and the frontier -----------------------------------------------------------------

@query
def page_types(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    outcome = P.fold_fetches(R.fetch_attempts(part))
    scraped = scrape(shop_pages(spark, sf), R.wrappers(part)).select("page_id", "url", "isbn", "offer")
    return P.classify(outcome.join(scraped, "url", "left")).select("page_id", "attempts", "type")


def _frontier_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    reached = kind != "error"
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("url"),
        F.concat(F.lit("d"), F.col("user_id") % 5).alias("domain"),
        F.when(reached, F.concat(F.lit("c"), "event_id")).alias("canonical_url"),
        F.when(reached, F.concat(F.lit("t"), "event_id")).alias("title"),
        F.when(kind == "error", "UNREACHABLE").when(kind == "signup", "JUNK")
        .when(kind == "view", "UNAVAILABLE").otherwise("PRODUCT").alias("type"),
        F.when(reached, utc("ts")).alias("retrieved_time"),
        F.when(reached, F.concat(F.lit("job"), F.col("event_id") % 3)).alias("last_job"),
        utc("ts").alias("seen_at"),
    )


@query
def frontier_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frontier_events(spark, sf)
    stored = rows.groupBy("url").agg(
        F.min("domain").alias("domain"), F.lit("stored").alias("canonical_url"),
        F.lit("stored").alias("title"), F.lit("PRODUCT").alias("type"),
        F.min("seen_at").alias("retrieved_time"), F.lit("job9").alias("last_job"))
    return P.upsert_frontier(stored, rows).select(
        "url", "domain", "canonical_url", "title", "type",
        F.unix_micros("retrieved_time").alias("retrieved_us"), "last_job")


@query
def frontier_late(spark: SparkSession, sf: str) -> DataFrame:
    """A scrape that arrives late: what is stored of every other page is newer than all of it."""
    rows = _frontier_events(spark, sf)
    newer = F.try_to_number(F.substring("url", 2, 20), F.lit("9999999999")) % 2 == 0
    stored = rows.groupBy("url").agg(
        F.min("domain").alias("domain"), F.min("seen_at").alias("low"), F.max("seen_at").alias("high"),
    ).select(
        "url", "domain", F.lit("stored").alias("canonical_url"), F.lit("stored").alias("title"),
        F.lit("PRODUCT").alias("type"),
        F.when(newer, F.col("high") + F.expr("interval 1 day")).otherwise(F.col("low")).alias("retrieved_time"),
        F.lit("job9").alias("last_job"))
    return P.upsert_frontier(stored, rows).select(
        "url", "domain", "canonical_url", "title", "type",
        F.unix_micros("retrieved_time").alias("retrieved_us"), "last_job")


@query
def frontier_resume(spark: SparkSession, sf: str) -> DataFrame:
    frontier = table(spark, sf, "events").select(
        F.concat(F.lit("e"), "event_id").alias("url"), F.col("event_type").alias("domain"),
        F.when(F.col("user_id") % 3 == 0, "JUNK").when(F.col("user_id") % 3 == 1, "PRODUCT")
        .alias("type"),
        utc("ts").alias("retrieved_time"),
        F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("job"), F.col("event_id") % 4))
        .alias("last_job"),
    )
    return P.select_frontier(frontier, "click", "job1").select(
        "url", "type", "last_job", F.unix_micros("retrieved_time").alias("retrieved_us"))


@query
def frontier_next(spark: SparkSession, sf: str) -> DataFrame:
    """The next pages of every domain while each domain has a running job."""
    events = table(spark, sf, "events")
    frontier = events.select(
        F.concat(F.lit("e"), "event_id").alias("url"), F.col("event_type").alias("domain"),
        F.when(F.col("user_id") % 3 == 0, "JUNK").when(F.col("user_id") % 3 == 1, "PRODUCT").alias("type"),
        F.when(F.col("event_id") % 50 > 0, F.date_trunc("hour", utc("ts"))).alias("retrieved_time"),
        F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("job"), F.col("event_id") % 4)).alias("last_job"))
    jobs = events.select(
        F.col("event_type").alias("domain"), F.concat(F.lit("job"), F.length("event_type") % 4).alias("job_id")).distinct()
    return P.next_pages(frontier, NEXT, jobs).select(
        "domain", "place", "url", "type", "last_job", F.unix_micros("retrieved_time").alias("retrieved_us"))


@query
def fetch_fold(spark: SparkSession, sf: str) -> DataFrame:
    attempts = table(spark, sf, "events").select(
        F.col("event_type").alias("job_id"), F.concat(F.lit("u"), "user_id").alias("url"),
        (F.col("event_id") % 3).cast("int").alias("attempt"), (F.col("value") > 40).alias("ok"))
    return P.fold_fetches(attempts).select(
        "job_id", "url", F.col("reached").cast("int").alias("reached"), "attempts")


# --- the catalog -----------------------------------------------------------------------------------

def line_observations(spark: SparkSession, sf: str, condition: str = "true") -> DataFrame:
    return observe(spread(table(spark, sf, "lineitem")).filter(condition))


def observe(lineitem: DataFrame) -> DataFrame:
    """Book observations: a line is a scrape of its part at its supplier's shop on the ship date."""
    k, shop = F.col("l_partkey"), F.col("l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = lineitem.select("*", cents.alias("cents"), R.isbn13_of(k).alias("isbn13"))
    isbn = F.col("isbn13")
    observed = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"),
        F.concat(F.lit("https://www.s"), shop, F.lit(".example.ro/"), "l_orderkey", F.lit("/"),
                 "l_linenumber", F.lit("/"), F.col("l_quantity").cast("int"), F.lit("/"), "cents")
        .alias("url"),
        utc("l_shipdate").alias("retrieved_time"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("T"), shop)).alias("title"),
        F.concat(F.lit("A"), F.repeat(F.lit("a"), (shop % 7).cast("int"))).alias("authors"),
        F.when(F.col("l_linenumber") % 3 == 0, F.left(isbn, F.lit(12))).otherwise(isbn).alias("isbn"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("D"), "l_orderkey")).alias("description"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("P"), shop)).alias("publisher"),
        F.lit(None).cast("string").alias("format"),
        F.concat(F.lit("i"), "l_orderkey", F.lit(".jpg")).alias("image_url"),
        F.array_sort(F.array(F.concat(F.lit("k"), shop % 5), F.concat(F.lit("p"), k)))
        .alias("keywords"),
        (F.col("cents") / 100).cast("decimal(18,2)").alias("_value"),
    )
    site = site_of(F.col("url"))
    ron = F.lit("RON")
    offer = F.struct(
        C.offer_id(site, F.col("url"), F.col("retrieved_time"), F.col("_value"), ron).alias("offer_id"),
        F.col("_value").alias("nominal_value"), ron.alias("currency"), "retrieved_time", "url",
        F.lit("").alias("page_title"), site.alias("site"),
        F.lit(None).cast("string").alias("availability"))
    return observed.withColumn("offer", offer).drop("_value")


def _book_columns(books: DataFrame) -> DataFrame:
    return books.select(
        "isbn", "title", "authors", "description", "publisher", "image_url",
        joined("keywords").alias("keywords"), joined("isbns").alias("isbns"),
        double("best_offer.nominal_value").alias("best_value"),
        F.unix_micros("best_offer.retrieved_time").alias("best_us"),
        F.col("best_offer.url").alias("best_url"))


@query
def merged_books(spark: SparkSession, sf: str) -> DataFrame:
    return _book_columns(C.merge_books(line_observations(spark, sf)))


@query
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same catalog in two steps: lines of status F are stored first, the others arrive."""
    path = work_folder(spark, "upsert")
    write_books(C.merge_books(line_observations(spark, sf, "l_linestatus = 'F'")), path, 0)
    fresh = line_observations(spark, sf, "l_linestatus <> 'F'")
    return _book_columns(C.upsert_catalog(read_batches(spark, path).drop("batch"), fresh))


@query
def catalog_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A versioned catalog: lines of status F, then the others, then some lines once more; two of its versions."""
    root = work_folder(spark, "books")
    first = C.upsert_books(spark, root, line_observations(spark, sf, "l_linestatus = 'F'"), buckets=16)
    C.upsert_books(spark, root, line_observations(spark, sf, "l_linestatus <> 'F'"), buckets=16)
    last = C.upsert_books(spark, root, line_observations(spark, sf, "l_partkey % 97 = 0"), buckets=16)
    return reduce(DataFrame.unionByName, [
        _book_columns(snapshots.read_version(spark, root, BOOKS, at)).withColumn("version", F.lit(name))
        for name, at in (("first", first), ("last", last))])


@query
def isbn_match(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "part").select(R.isbn13_of(F.col("p_partkey")).alias("isbn"))
    stored = line_observations(spark, sf).groupBy("isbn").agg(F.min("page_id").alias("book_id"))
    return C.match_books(new, stored)


@query
def best_offer(spark: SparkSession, sf: str) -> DataFrame:
    offers = line_observations(spark, sf).select("isbn", "offer", F.struct("page_id", "url").alias("seq"))
    return C.best_offer(offers, "isbn").select(
        "isbn", double("best_offer.nominal_value").alias("value"),
        F.unix_micros("best_offer.retrieved_time").alias("retrieved_us"),
        F.col("best_offer.url").alias("url"))


@query
def offer_history(spark: SparkSession, sf: str) -> DataFrame:
    """Offers that a second scrape of everything adds to those of the lines of status F."""
    stored = C.offer_rows(line_observations(spark, sf, "l_linestatus = 'F'"))
    added = C.append_offers(stored, C.offer_rows(line_observations(spark, sf)))
    return added.groupBy("isbn", "site").agg(
        F.count("*").alias("n"), double(F.sum("nominal_value")).alias("total"))


@query
def book_history(spark: SparkSession, sf: str) -> DataFrame:
    """Dated offers per merged book, short and full ISBNs together."""
    seen = line_observations(spark, sf)
    dated = C.book_offers(C.merge_books(seen), C.offer_rows(seen))
    return dated.groupBy("book_isbn").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("retrieved_time")).alias("first_us"),
        F.unix_micros(F.max("retrieved_time")).alias("last_us"))


@query
def distinct_offers(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.offer_rows(line_observations(spark, sf))
    return C.distinct_offers(rows.unionByName(rows)).select(
        "url", "site", F.unix_micros("retrieved_time").alias("retrieved_us"),
        double("nominal_value").alias("value"), "currency")


@query
def distinct_books(spark: SparkSession, sf: str) -> DataFrame:
    seen = line_observations(spark, sf)
    books = seen.select(
        F.lit(None).cast("bigint").alias("book_id"), "isbn", "title", "authors",
        F.lit(None).cast("string").alias("description"), "publisher", "format",
        F.lit(None).cast("string").alias("image_url"), "keywords", F.col("offer").alias("best_offer"))
    return C.distinct_books(books).select(
        "isbn", "title", "authors", "publisher", joined("keywords").alias("keywords"),
        F.unix_micros("best_offer.retrieved_time").alias("best_us"))


@query
def keyword_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "keywords")
    heuristic_books(shop_pages(spark, sf)).select("page_id", "title", "keywords").write.parquet(path)
    return C.find_books(spark.read.parquet(path), keyword=KEYWORD).select("page_id", "title")


@query
def site_offers(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "offers")
    write_offers(C.offer_rows(line_observations(spark, sf)), path, 0)
    return C.find_offers(read_batches(spark, path, OFFERS), SITE).select(
        "url", F.unix_micros("retrieved_time").alias("retrieved_us"), double("nominal_value").alias("value"))


@query
def book_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Books of a written catalog by each of the indexed fields."""
    path = work_folder(spark, "lookup")
    write_books(C.merge_books(line_observations(spark, sf)), path, 0)
    books = read_batches(spark, path, BOOKS)
    found = [C.find_books(books, **{field: value}).select(F.lit(field).alias("field"), "isbn", "title")
             for field, value in LOOKUPS.items()]
    return reduce(DataFrame.unionByName, found)


@query
def indexed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The same books in a catalog of three batches that overlap, found by its index."""
    root = work_folder(spark, "indexed")
    for batch, condition in enumerate(("l_linestatus = 'F'", "l_linestatus <> 'F'", "l_linenumber = 1")):
        S.add_books(C.merge_books(line_observations(spark, sf, condition)), root, batch)
        commit_batch(spark, root, batch)
    found = [S.lookup_books(spark, root, **{field: value}).select(F.lit(field).alias("field"), "isbn", "title")
             for field, value in LOOKUPS.items()]
    return reduce(DataFrame.unionByName, found)


@query
def catalog_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scrape all pages once, write every table, read the books and their offers back."""
    root = work_folder(spark, "roundtrip")
    scraped = P.classify(scrape(shop_pages(spark, sf), R.wrappers(table(spark, sf, "part"))))
    scraped.write.parquet(f"{root}/scraped")
    rows = spark.read.parquet(f"{root}/scraped")
    found = C.observations(rows)
    write_offers(C.offer_rows(found, "job"), f"{root}/offers", 0)
    write_books(C.merge_books(found), f"{root}/books", 0)
    write_frontier(P.frontier_rows(rows, "job"), f"{root}/frontier", 0)
    books, offers = read_batches(spark, f"{root}/books"), read_batches(spark, f"{root}/offers")
    return C.book_offers(books, offers).join(
        books.select("book_id", "title", "authors", "publisher"), "book_id").select(
        F.col("book_isbn").alias("isbn"), "title", "authors", "publisher", "site",
        double("nominal_value").alias("nominal_value"), "availability")


# --- jobs ------------------------------------------------------------------------------------------

def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("j"), "o_orderkey").alias("job_id"),
        F.concat(F.lit("s"), F.col("o_custkey") * 7, F.lit(".example.ro")).alias("domain"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRAWL").otherwise("SCRAPE").alias("type"),
        F.when(status == "O", "ACTIVE").when(status == "F", "FINISHED").otherwise("STOPPED")
        .alias("status"),
        utc("o_orderdate").alias("start"),
        F.when(status == "F", utc("o_orderdate") + F.expr("interval 1 day")).alias("end"),
    )


@query
def jobs_active(spark: SparkSession, sf: str) -> DataFrame:
    return J.active_jobs(_jobs(spark, sf)).select(
        "job_id", "domain", F.unix_micros("start").alias("start_us"))


@query
def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return J.job_by_id(_jobs(spark, sf), JOB).select("job_id", "domain", "status")


@query
def jobs_closed(spark: SparkSession, sf: str) -> DataFrame:
    closing = table(spark, sf, "events").select(
        F.concat(F.lit("j"), "user_id").alias("job_id"), utc("ts").alias("closed_at"))
    return J.close_jobs(_jobs(spark, sf), closing).select(
        "job_id", "status", F.coalesce(F.unix_micros("end"), F.lit(-1)).alias("end_us"))


@query
def job_durations(spark: SparkSession, sf: str) -> DataFrame:
    return J.job_durations(_jobs(spark, sf)).select(
        "job_id", "domain", F.coalesce("total_ms", F.lit(-1)).alias("total_ms"))


@query
def job_triage(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    site = F.concat(F.lit("https://www.S"), u, F.lit(".example.ro/start"))
    body = (
        F.when(e % 7 == 0, F.lit("{}"))
        .when(e % 7 == 1, F.lit('{"homepage": 5}'))
        .when(e % 7 == 2, F.lit('{"homepage": "not a url"}'))
        .when(e % 7 == 3, F.concat(
            F.lit('{"homepage": "'), site, F.lit('", "continue": '),
            F.when(e % 3 == 0, F.concat(F.lit('"c'), e, F.lit('"'))).when(e % 3 == 1, F.lit("5"))
            .otherwise(F.concat(F.lit('"'), F.lpad(e.cast("string"), 24, "0"), F.lit('"'))), F.lit("}")))
        .when(e % 7 == 4, F.lit("no json"))
        .otherwise(F.concat(F.lit('{"homepage": "'), site, F.lit('"}')))
    )
    requests = table(spark, sf, "events").select(
        e.alias("request_id"), body.alias("body"), utc("ts").alias("requested_at"))
    return J.triage_requests(requests, _jobs(spark, sf))


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("j"), F.col("user_id") % 10).alias("job_id"),
        F.concat(F.lit("d"), F.col("user_id") % 10).alias("domain"),
        F.concat(F.lit("u"), "user_id", F.lit("/"), F.col("event_id") % 20).alias("url"),
        (F.col("value") > 20).alias("ok"),
        F.when(F.col("event_type") == "purchase", "PRODUCT").otherwise("JUNK").alias("type"),
        "event_id", "event_type", "ts", "value",
    )


@query
def job_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _attempts(spark, sf)
    return J.job_stats(rows, rows.select("job_id", "domain", "type"))


@query
def job_timings(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.round(F.col("value") * 100).cast("bigint")
    rows = _attempts(spark, sf).select(
        "job_id", "domain", (F.col("event_type") != "error").alias("reached"),
        (F.col("type") == "PRODUCT").alias("paired"), ms.alias("download_ms"),
        (ms * 2).alias("processing_ms"), (ms % 97).alias("crawl_persist_ms"),
        (ms % 13).alias("product_persist_ms"))
    return J.job_timings(rows)


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    return _attempts(spark, sf).select(
        F.col("event_type").alias("job_id"), utc("ts").alias("requested_at"),
        F.col("event_id").alias("page_id"), (F.col("event_id") % 2 + 1).alias("attempts"),
        F.col("ok").alias("reached"), "type")


@query
def job_batches(spark: SparkSession, sf: str) -> DataFrame:
    return J.batch_stats(_requested(spark, sf), BATCH)


# --- streams -----------------------------------------------------------------------------------------

def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of part files."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_page_types(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    pages = R.render_shop_pages(
        _table_stream(spark, sf, "part").repartition(spark.sparkContext.defaultParallelism))
    out = work_folder(spark, "stream-types")
    typed = S.stream_scrape(pages, R.wrappers(part)).select("page_id", "site", "type")
    typed.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(typed.schema).parquet(f"{out}/rows")


@query
def stream_best_offer(spark: SparkSession, sf: str) -> DataFrame:
    """The running state, written per micro-batch; the last row per ISBN is the result."""
    lines = observe(_table_stream(spark, sf, "lineitem")).select(
        "isbn", "offer", F.struct("page_id", "url").alias("seq"))
    out = work_folder(spark, "stream-offers")
    state = S.stream_best_offer(lines, "isbn")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    state.writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = read_batches(spark, f"{out}/rows")
    return rows.groupBy("isbn").agg(F.max_by("best_offer", "batch").alias("o")).select(
        "isbn", double("o.nominal_value").alias("value"),
        F.unix_micros("o.retrieved_time").alias("retrieved_us"), F.col("o.url").alias("url"))


@query
def stream_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Shop pages streamed into the catalog tables; books with their best offer read back."""
    part = table(spark, sf, "part")
    pages = R.render_shop_pages(
        _table_stream(spark, sf, "part").repartition(spark.sparkContext.defaultParallelism))
    root = work_folder(spark, "stream-catalog")
    S.run_catalog_stream(pages, root, "job", R.wrappers(part)).awaitTermination()
    return S.read_books(spark, root).select(
        "isbn", "title", "authors", "publisher", F.col("best_offer.site").alias("site"),
        double("best_offer.nominal_value").alias("nominal_value"), "best_offer.availability")


@query
def stream_wrapper_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Selectors are edited while the catalog stream runs; pages of the time before come late as well."""
    part, pages = table(spark, sf, "part"), shop_pages(spark, sf)
    source, store, root = (work_folder(spark, n) for n in ("pages", "wrappers", "stream-versions"))
    half = _half(part)
    early = (F.unix_seconds("retrieved_time") < R.EPOCH + half) & (F.col("page_id") % 2 == 1)
    pages.where(early).write.mode("append").parquet(source)
    publish_wrappers(R.wrappers(part), store)
    running_stream = S.run_catalog_stream(
        stream_pages(spark, source, RAW_PAGES, max_files=1000), root, "job", lambda: read_wrappers(spark, store),
        trigger={"processingTime": "0 seconds"})
    try:
        running_stream.processAllAvailable()
        publish_wrappers(R.edited_wrappers(part), store, datetime.fromtimestamp(R.EPOCH + half, timezone.utc))
        pages.where(~early).write.mode("append").parquet(source)
        running_stream.processAllAvailable()
    finally:
        running_stream.stop()
    return S.read_books(spark, root).select(
        "isbn", "title", "authors", "publisher", F.col("best_offer.site").alias("site"),
        double("best_offer.nominal_value").alias("nominal_value"), "best_offer.availability")


@query
def stream_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Every shop page is delivered twice, in different files; each offer is in the catalog once."""
    source, root = work_folder(spark, "pages"), work_folder(spark, "stream-offers")
    pages = shop_pages(spark, sf)
    for copy in (1, 2):
        pages.write.parquet(f"{source}/copy={copy}")
    files = len(spark.read.parquet(source).inputFiles())
    stream = stream_pages(spark, source, f"{RAW_PAGES}, copy int", max_files=(files + 1) // 2).drop("copy")
    S.run_catalog_stream(stream, root, "job", R.wrappers(table(spark, sf, "part"))).awaitTermination()
    return S.read_offers(spark, root).select(
        "url", "site", "isbn", F.unix_micros("retrieved_time").alias("retrieved_us"),
        double("nominal_value").alias("nominal_value"))


@query
def stream_offer_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Latest offer per ISBN, of those seen within the time to live before the end of the stream."""
    lines = observe(_table_stream(spark, sf, "lineitem")).select(
        "isbn", "offer", F.struct("page_id", "url").alias("seq"))
    root = work_folder(spark, "current-offers")
    schema = expiry.stream_current_offers(lines, "isbn", ttl=TTL, late=LATE).schema
    expiry.run_current_offers(lines, root, "isbn", ttl=TTL, late=LATE).awaitTermination()
    return expiry.read_current_offers(spark, root, "isbn", schema=schema).select(
        "isbn", double("best_offer.nominal_value").alias("value"),
        F.unix_micros("best_offer.retrieved_time").alias("retrieved_us"), F.col("best_offer.url").alias("url"),
        F.unix_micros("expires_at").alias("expires_us"))


@query
def stream_job_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of running jobs, whose pages come in four parts that overlap in time."""
    source, root = work_folder(spark, "requested"), work_folder(spark, "job-batches")
    rows = _requested(spark, sf).withColumn("day", F.unix_date(F.col("requested_at").cast("date")) + F.col("page_id") % 2)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    part = F.least(F.floor((F.col("day") - first) * 4 / (last - first + 1)), F.lit(3))
    rows = rows.withColumn("file", part.cast("int")).drop("day")
    for k in range(4):
        rows.where(F.col("file") == k).drop("file").write.mode("append").parquet(source)
    written = spark.read.parquet(source)
    stream = spark.readStream.schema(written.schema).option(
        "maxFilesPerTrigger", max(1, len(written.inputFiles()) // 4)).parquet(source)
    running.run_job_statistics(stream, root, BATCH, late="3 days").awaitTermination()
    return running.read_job_statistics(spark, root, BATCH)


@query
def stream_distinct_offers(spark: SparkSession, sf: str) -> DataFrame:
    """All offers delivered three times, once long after their own time; each leaves the stream once."""
    source, out = work_folder(spark, "delivered"), work_folder(spark, "distinct-offers")
    # Sorted rows take less room on disk, here and in the shuffle; the later deliveries are copies of the first.
    offers = C.offer_rows(line_observations(spark, sf)).select(*C.OFFER_KEY, "site").sortWithinPartitions("url")
    for copy in range(3):
        if copy == 1:
            offers = spark.read.parquet(source).drop("delivered_at")
        offers.withColumn("delivered_at", F.timestamp_seconds(F.lit(R.EPOCH + copy * 3600))).write.mode("append").option(
            "compression", "zstd").parquet(source)
    schema = spark.read.parquet(source).schema
    files = len(spark.read.parquet(source).inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(source)
    kept = S.stream_distinct_offers(stream, "delivered_at", within="1 day")
    kept.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("compression", "zstd").option(
        "path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/rows").select(
        "url", "site", F.unix_micros("retrieved_time").alias("retrieved_us"),
        double("nominal_value").alias("value"), "currency")


# --- the flagship --------------------------------------------------------------------------------------

@query
def shop_overview(spark: SparkSession, sf: str) -> DataFrame:
    """How many pages of each shop are products, and at what price?"""
    typed = P.classify(scrape(shop_pages(spark, sf), R.wrappers(table(spark, sf, "part"))))
    return typed.groupBy("site", "type").agg(
        F.count("*").alias("pages"),
        double(F.min("offer.nominal_value")).alias("lowest"),
        double(F.max("offer.nominal_value")).alias("highest"))


QUERIES["wrapper_books"] = QUERIES.pop("wrapper_books_query")

"""Books and offers: matching by ISBN, merging observations, the latest offer, upserts, lookups.

The merge is a grouped fold. Every field keeps its winning value together with the order of the
observation it came from, so the fold is associative, ignores repeated input and gives the same
catalog for any input order or split into batches. A catalog row is itself the state of the fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopcat.functions.isbn import is_odd_isbn, isbn_book, isbn_rank, isbn_stem
from shopcat.functions.words import PRODUCT
from shopcat.operators.joins import BROADCAST_BYTES, fits_broadcast, measured_bytes
from shopcat.schemas import BOOKS, SEQ
from shopcat.session import work_folder
from shopcat.sources import snapshots
from shopcat.sources.tables import remove

_FIRST = ("title", "publisher", "format", "image_url", "book_id")
_LONGEST = ("authors", "description")
_STATES = _FIRST + _LONGEST + ("isbn", "offer")
OFFER_KEY = ("currency", "nominal_value", "retrieved_time", "url")
BOOK_KEY = ("authors", "image_url", "description", "format", "book_id", "isbn", "keywords",
            "publisher", "title")


def observations(scraped: DataFrame) -> DataFrame:
    """Rows of the scraped pages that go into the catalog: the PRODUCT pages."""
    return scraped.filter(F.col("type") == PRODUCT).select(
        "page_id", "url", "retrieved_time", "title", "authors", "isbn", "description",
        "publisher", "format", "image_url", "keywords", "offer")


# --- merge ------------------------------------------------------------------------------------

def _state(value: Column, seq: Column, *before: Column) -> Column:
    order = [b.alias(f"o{i}") for i, b in enumerate(before)]
    return F.when(value.isNotNull(), F.struct(*order, seq.alias("seq"), value.alias("value")))


def _states(value, seq, isbn: Column, offer: Column) -> dict[str, Column]:
    """The state of every field; ``value(f)`` and ``seq(f)`` give a field's value and order."""
    return {
        **{f: _state(value(f), seq(f)) for f in _FIRST},
        **{f: _state(value(f), seq(f), -F.length(value(f))) for f in _LONGEST},
        "isbn": _state(isbn, seq("isbn")),
        "offer": _state(offer, seq("best_offer"), offer["retrieved_time"]),
    }


def _winner(field: str, state: Column) -> Column:
    return (F.max(state) if field == "offer" else F.min(state)).alias(f"s_{field}")


def fold_observations(obs: DataFrame, lead: str = "book_id") -> DataFrame:
    """State rows of observations, one per ISBN: ``stem, isbn, words, isbns, s_*``.

    Observations of an ISBN that lost its check digit fold with those of the full form (:func:`isbn_book`), where there are
    any: of all ISBNs of a stem a valid one comes first, so nothing else could take them.

    The field states and the word sets are folded apart, each after a partial fold of the input
    partition: a hot ISBN is reduced before it moves, and the union of its keywords is held as a
    set of words, never as a list of rows. Both sides are partitioned alike, so their join moves
    nothing. ``obs`` is read twice, the second time only its ISBN and keywords. The hash of the key, named ``lead``,
    leads the keys: sorts by it seldom compare ISBNs, which begin alike.
    """
    rows = obs.filter(F.col("isbn").isNotNull()).withColumn("isbn_key", isbn_book(F.col("isbn"))).withColumn(
        lead, F.xxhash64("isbn_key"))
    keys = (lead, "isbn_key")
    seq = F.struct(F.lit(1).alias("arrival"), "retrieved_time", "page_id", "url").cast(SEQ)
    # The states of the ISBN and the book's id follow from the ISBNs and their first rows.
    states = _states(lambda f: F.lit(None) if f == "book_id" else F.col(f), lambda _: F.col("seq"), F.col("isbn"), F.col("offer"))
    known = ("book_id", "isbn")
    own = F.col("isbn") == F.col("isbn_key")
    folded = rows.withColumn("seq", seq).groupBy(*keys).agg(
        F.min(F.when(own, F.col("seq"))).alias("seq_own"), F.min(F.when(~own, F.col("seq"))).alias("seq_short"),
        *[_winner(f, states[f]) for f in _STATES if f not in known])
    words = rows.select(*keys, F.explode("keywords").alias("word")).groupBy(*keys).agg(F.collect_set("word").alias("words"))

    stem = isbn_stem(F.col("isbn_key"))
    short, full = F.col("seq_short").isNotNull(), F.col("seq_own").isNotNull()
    first = {  # of the full ISBN, and of the one that lost its check digit
        "full": (full, F.col("seq_own"), F.col("isbn_key")), "short": (short, F.col("seq_short"), stem)}

    def state(which: str, value) -> Column:
        there, seq, isbn = first[which]
        return F.when(there, F.struct(seq.alias("seq"), value(isbn).alias("value")))

    both = {"isbn": F.coalesce(state("full", lambda i: i), state("short", lambda i: i)),
            "book_id": F.least(state("full", F.xxhash64), state("short", F.xxhash64))}
    return folded.join(words, list(keys), "left").select(
        stem.alias("stem"), F.when(full, F.col("isbn_key")).otherwise(stem).alias("isbn"), "words",
        F.array_compact(F.array(F.when(short, stem), F.when(full, F.col("isbn_key")))).alias("isbns"),
        *[(both[f] if f in both else F.col(f"s_{f}")).alias(f"s_{f}") for f in _STATES])


def _states_of_books(books: DataFrame) -> DataFrame:
    # A book stored without the order of its fields comes before every observation.
    unknown = F.struct(
        F.lit(0).alias("arrival"), F.lit(None).cast("timestamp").alias("retrieved_time"),
        F.col("book_id").alias("page_id"), F.lit(None).cast("string").alias("url")).cast(SEQ)
    has_seqs = "seqs" in books.columns

    def seq(field: str) -> Column:
        return F.coalesce(F.col(f"seqs.{field}"), unknown) if has_seqs else unknown

    isbns = F.col("isbns") if "isbns" in books.columns else F.array("isbn")
    states = _states(F.col, seq, F.col("isbn"), F.col("best_offer"))
    return books.filter(F.col("isbn").isNotNull()).select(
        isbn_stem(F.col("isbn")).alias("stem"), "isbn", F.col("keywords").alias("words"),
        isbns.alias("isbns"), *[states[f].alias(f"s_{f}") for f in _STATES])


def _union(arrays: str) -> Column:
    """Sorted union of arrays. Equal arrays, as of an unchanged book in many batches, are held once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arrays)))).alias(arrays)


def _catalog(states: DataFrame) -> DataFrame:
    """Catalog rows of the state rows of whole books."""

    def value(field: str, name: str | None = None) -> Column:
        return F.col(f"s_{field}.value").alias(name or field)

    seqs = F.struct(*[
        F.col(f"s_{f}.seq").alias("best_offer" if f == "offer" else f) for f in _STATES])
    return states.select(
        value("book_id"), value("isbn"), value("title"), value("authors"), value("description"),
        value("publisher"), value("format"), value("image_url"),
        F.array_sort(F.coalesce("words", F.array().cast("array<string>"))).alias("keywords"),
        value("offer", "best_offer"), F.array_sort("isbns").alias("isbns"), seqs.alias("seqs"),
    )


def _with_rank(states: DataFrame) -> DataFrame:
    """State rows whose state of the ISBN begins with its rank, so that a well-formed one wins."""
    return states.withColumn("rank", isbn_rank(F.col("isbn"))).withColumn(
        "s_isbn", F.struct("rank", "s_isbn.seq", "s_isbn.value"))


def _fold_states(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*keys).agg(*[_winner(f, F.col(f"s_{f}")) for f in _STATES], _union("words"), _union("isbns"))


def _books_by_isbn(states: DataFrame) -> DataFrame:
    """Fold state rows by :func:`isbn_book`; right where no stem has a full ISBN but the valid one."""
    return _catalog(_fold_states(_with_rank(states).withColumn("book", isbn_book(F.col("isbn"))), "stem", "book"))


def _books_by_stem(states: DataFrame, folded: bool = False) -> DataFrame:
    """Fold state rows, looking at all ISBNs of a stem. ``folded`` says that there is one row per ISBN already."""
    # Rows of one ISBN fold first, before they move; so a book of many batches is one row per ISBN when
    # its stem is put together.
    by_isbn = states if folded else _fold_states(states, "stem", "isbn")
    # A short ISBN belongs to the full one with the same stem: a valid check digit first, then
    # the smallest.
    full = F.length("isbn").isin(10, 13)
    best_full = F.min(F.when(full, F.struct("rank", "isbn"))).over(Window.partitionBy("stem"))
    merged = _with_rank(by_isbn).withColumn("_full", best_full).withColumn(
        "canonical", F.when(full | F.col("_full").isNull(), F.col("isbn")).otherwise(F.col("_full.isbn")))
    return _catalog(_fold_states(merged, "stem", "canonical"))


def _parted(rows: DataFrame, plain: Callable[[DataFrame], DataFrame], mixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``mixed`` of the rows of stems with an odd ISBN, and ``plain`` of all others, which then move once.

    One job reads the ISBNs of ``rows``, one more measures the odd stems if there are any. If these are too many for a
    broadcast, all rows are mixed. The test of an ISBN is an aggregate, as a filter would repeat it in the scan.
    """
    if not rows.agg(F.max(is_odd_isbn(F.col("isbn"))).alias("odd")).first()["odd"]:
        return plain(rows)
    odd = rows.groupBy(isbn_stem(F.col("isbn")).alias("_odd")).agg(F.max(is_odd_isbn(F.col("isbn"))).alias("any")).where(
        "any").select("_odd")
    if measured_bytes(odd) > BROADCAST_BYTES:
        return mixed(rows)
    keyed, few = rows.withColumn("_odd", isbn_stem(F.col("isbn"))), F.broadcast(odd)
    return plain(keyed.join(few, "_odd", "left_anti").drop("_odd")).unionByName(
        mixed(keyed.join(few, "_odd", "left_semi").drop("_odd")))


def merge_states(states: DataFrame) -> DataFrame:
    """Fold state rows (few per book) into one catalog row per book.

    A stem holds the ISBNs that differ in the check digit only.
    """
    return _parted(states, _books_by_isbn, _books_by_stem)


def merge_books(obs: DataFrame) -> DataFrame:
    """Merge observations of the same book.

    title, publisher, format, image: first known value. authors, description: the longest, the
    earlier on a tie. isbn: a well-formed one is preferred. keywords: union. best_offer: the
    latest. A short ISBN (check digit lost) joins its full form whatever comes first.
    """
    def folded(rows: DataFrame) -> DataFrame:
        return fold_observations(rows, lead="isbn_hash")

    return _parted(obs, lambda rows: _catalog(folded(rows)), lambda rows: _books_by_stem(folded(rows), folded=True))


def upsert_catalog(books: DataFrame, obs: DataFrame) -> DataFrame:
    """Stored books and new observations to a new catalog.

    The new rows are folded once, into a table of the work folder. Only stored books that share an ISBN stem
    with them go through the merge; the others pass unchanged.
    """
    spark = obs.sparkSession
    path = work_folder(spark, "fresh")
    fold_observations(obs).write.option("compression", "zstd").parquet(path)
    fresh = spark.read.parquet(path)
    stems = fresh.select("stem").distinct()
    met, others = split_by_stem(books, stems, fits_broadcast(stems))
    merged = merge_states(_states_of_books(met).unionByName(fresh))
    return merged.unionByName(others, allowMissingColumns=True)


def split_by_stem(stored: DataFrame, stems: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Stored books that share a stem with new rows, and the others.

    Where the stems are few enough to be sent to every task, the stored books are not moved. Else they are moved once:
    both joins read the same rows, so they share the shuffle.
    """
    keyed = stored.withColumn("stem", isbn_stem(F.col("isbn")))
    lookup, known = F.broadcast(stems) if small else stems, keyed.where("stem IS NOT NULL")
    met, others = (known.join(lookup, "stem", how).drop("stem") for how in ("left_semi", "left_anti"))
    return met, others.unionByName(keyed.where("stem IS NULL").drop("stem"))


def upsert_books(spark: SparkSession, root: str, obs: DataFrame, batch: int | None = None,
                 buckets: int = snapshots.BUCKETS) -> snapshots.Manifest:
    """Merge new observations into the books of a versioned table; see :mod:`shopcat.sources.snapshots`.

    Books are kept in buckets of their ISBN stem, so all books that can merge are in one. Only buckets with new rows
    are read and written; the others go into the new version by reference. Within a bucket only books that
    share a stem with new rows go through the merge. The stored books are not shuffled while the new stems fit
    a broadcast. A ``batch`` that the table holds already changes nothing.
    """
    base = snapshots.base_of(spark, root, buckets)
    if batch is not None and base.batch is not None and base.batch >= batch:
        return base
    path = work_folder(spark, "fresh")
    bucket = snapshots.bucket_of(F.col("stem"), base.buckets)
    fold_observations(obs).withColumn("bucket", bucket).write.option("compression", "zstd").parquet(path)
    fresh = spark.read.parquet(path)
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one row per bucket
    if not touched:
        remove(spark, path)
        return base
    stored = snapshots.read_version(spark, root, BOOKS, base, touched)
    stems = fresh.select("stem").distinct()
    met, others = split_by_stem(stored, stems, fits_broadcast(stems))
    merged = merge_states(_states_of_books(met).unionByName(fresh.drop("bucket")))
    stem_bucket = snapshots.bucket_of(isbn_stem(F.col("isbn")), base.buckets)
    rows = merged.select(*others.columns).withColumn("bucket", stem_bucket).repartition("bucket").unionByName(
        others.withColumn("bucket", stem_bucket))
    new = snapshots.write_data(spark, root, rows)
    remove(spark, path)
    return snapshots.publish(spark, root, base, base.folders | {k: new.get(k, []) for k in touched}, batch)


def compact_books(*snapshots: DataFrame, few: bool = False) -> DataFrame:
    """Fold several catalog tables into one. ``few`` rows are looked at by stem without a job over their ISBNs before."""
    states = reduce(DataFrame.unionByName, [_states_of_books(s) for s in snapshots])
    return _books_by_stem(states) if few else merge_states(states)


# --- matching and offers ------------------------------------------------------------------------

def match_books(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored books that match a new ISBN: equal to it, or to it without its last character.

    One row per distinct new ISBN and stored book: ``isbn, match, stored_isbn, book_id``. The new
    side is reduced to its distinct ISBNs before the join.
    """
    keys = new.filter(F.col("isbn").isNotNull()).select("isbn").distinct().select(
        "isbn",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("exact").alias("match"), F.col("isbn").alias("stored_isbn")),
            F.when(F.length("isbn") >= 1, F.struct(
                F.lit("prefix").alias("match"),
                F.left("isbn", F.length("isbn") - 1).alias("stored_isbn"))),
        ))).alias("k"),
    ).select("isbn", "k.match", "k.stored_isbn")
    return keys.join(
        stored.select(F.col("isbn").alias("stored_isbn"), "book_id"), "stored_isbn"
    ).select("isbn", "match", "stored_isbn", "book_id")


def best_offer(offers: DataFrame, *keys: str) -> DataFrame:
    """Latest offer per ``keys``; of equal times the later arrival (``seq``) wins, null never.

    ``offers`` has ``offer`` (struct with ``retrieved_time``) and ``seq``. "Best" is the latest
    one, not the cheapest.
    """
    order = F.struct(F.col("offer.retrieved_time").alias("retrieved_time"), "seq")
    known = F.when(F.col("offer").isNotNull(), F.struct(order.alias("order"), "offer"))
    return offers.groupBy(*keys).agg(F.max(known).alias("m")).select(
        *keys, F.col("m.offer").alias("best_offer"))


def offer_id(site: Column, url: Column, retrieved_time: Column, value: Column, currency: Column) -> Column:
    return F.xxhash64(site, url, retrieved_time, value, currency)


def offer_rows(obs: DataFrame, job_id: str | None = None) -> DataFrame:
    """Child rows of the offer table: one per observation with an offer.

    A row names the ISBN it was seen under; :func:`book_offers` finds its book, whose id is that of
    its first observation.
    """
    job = F.col("job_id") if "job_id" in obs.columns else F.lit(job_id).cast("string")
    return obs.filter(F.col("offer").isNotNull()).select(
        "offer.*", "isbn", job.alias("job_id"))


def distinct_offers(offers: DataFrame, *also: str) -> DataFrame:
    """One row per offer by currency, value, time and url (null-safe); the smallest rest is kept.

    ``also`` names columns that follow from the key, such as the site; filters on them reach the scan.
    """
    key = (*OFFER_KEY, *also)
    rest = [c for c in offers.columns if c not in key]
    if not rest:
        return offers.distinct()
    return offers.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(
        *key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*offers.columns)


def distinct_books(books: DataFrame) -> DataFrame:
    """One row per book by every field but the best offer; the latest offer is kept."""
    key = [c for c in BOOK_KEY if c in books.columns]
    rest = [c for c in books.columns if c not in key]
    folded = books.groupBy(*key)
    if not rest:
        return folded.agg().select(*books.columns)
    order = [F.col("best_offer.retrieved_time").alias("_t")] if "best_offer" in rest else []
    return folded.agg(F.max(F.struct(*order, *rest)).alias("r")).select(
        *key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*books.columns)


def append_offers(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that are not stored yet, each once.

    An offer's time is part of its identity, so pass only the stored rows of the new rows' time
    range when the history is long (``retrieved_time`` is pushed down). The id narrows the join;
    the full key decides, so a hash collision loses nothing.
    """
    fresh = distinct_offers(new)
    same = [F.col("n.offer_id") == F.col("s.offer_id")] + [
        F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in OFFER_KEY]
    known = stored.select("offer_id", *OFFER_KEY)
    return fresh.alias("n").join(known.alias("s"), reduce(and_, same), "left_anti")


def book_offers(books: DataFrame, offers: DataFrame) -> DataFrame:
    """Every dated offer of every merged book: ``book_id`` and canonical ``isbn`` with the offer.

    A book's row names all ISBNs it was observed under, so the join is on equal ISBNs; AQE splits
    a hot one.
    """
    names = books.select("book_id", F.col("isbn").alias("book_isbn"), F.explode("isbns").alias("isbn"))
    return offers.join(names, "isbn")


# --- lookups ------------------------------------------------------------------------------------

def find_books(
    books: DataFrame, title: str | None = None, authors: str | None = None,
    isbn: str | None = None, keyword: str | None = None, best_offer_site: str | None = None,
) -> DataFrame:
    """Books by indexed fields, all given conditions together. Equalities reach the scan."""
    conditions = [F.col(c) == v for c, v in
                  (("title", title), ("authors", authors), ("isbn", isbn),
                   ("best_offer.site", best_offer_site)) if v is not None]
    if keyword is not None:
        conditions.append(F.array_contains("keywords", keyword))
    return books.filter(reduce(and_, conditions)) if conditions else books


def find_offers(offers: DataFrame, site: str) -> DataFrame:
    """Offers of a site; skips row groups of a table that :func:`write_offers` sorted by site."""
    return offers.filter(F.col("site") == site)

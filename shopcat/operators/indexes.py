"""An inverted index of books: which ISBN stems hold a title, authors, a keyword or a site.

The books of a catalog in batches are known only after a fold over all of them. Every value that a folded book
can have is in a row of some batch with the same stem, so the index leads from values to stems, and only books with
these stems are folded. Keys are hashes: a collision costs a few rows, since the folded books are filtered again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.functions.isbn import isbn_stem

INDEX = "key bigint, stem string"
FEW = 100  # stems that go to the scan as conditions


def index_key(field: str, value: Column) -> Column:
    return F.xxhash64(F.lit(field), value)


def index_entries(books: DataFrame) -> DataFrame:
    """Entries (key, stem) of catalog rows. Nulls have none."""
    single = [F.when(F.col(c).isNotNull(), index_key(f, F.col(c))) for f, c in (
        ("title", "title"), ("authors", "authors"), ("best_offer_site", "best_offer.site"))]
    words = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: index_key("keyword", w))
    keys = F.concat(F.array_compact(F.array(*single)), words)
    return books.where("isbn IS NOT NULL").select(F.explode(keys).alias("key"), isbn_stem(F.col("isbn")).alias("stem")).distinct()


def stems_of(index: DataFrame, **wanted: str) -> DataFrame:
    """Stems of books that may match all the given fields; ``isbn`` needs no index."""
    spark, found = index.sparkSession, None
    for field, value in wanted.items():
        if field == "isbn":
            stems = spark.range(1).select(isbn_stem(F.lit(value)).alias("stem"))
        else:
            stems = index.where(F.col("key") == index_key(field, F.lit(value))).select("stem").distinct()
        found = stems if found is None else found.join(stems, "stem", "left_semi")
    return found


def with_stems(books: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows of ``books`` (with ``stem``) that have one of the stems.

    Up to ``FEW`` stems go into the scan, which then skips by statistics all pages of the files without them; more are joined.
    """
    some = [r["stem"] for r in stems.limit(FEW + 1).collect()]
    if len(some) > FEW:
        return books.join(stems, "stem", "left_semi")
    return books.where(reduce(or_, [F.col("stem") == s for s in some], F.lit(False)))

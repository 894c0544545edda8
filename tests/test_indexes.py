"""Lookups by index against lookups over the folded catalog."""

from pyspark.sql import functions as F

from shopcat.operators import catalog as C
from shopcat.operators.indexes import index_entries, index_key
from shopcat.schemas import BOOKS
from shopcat.session import work_folder
from shopcat.sources.tables import commit_batch, write_books
from shopcat.streaming import streams as S
from tests.test_catalog import observation, table


def found(books):
    return sorted(map(repr, books.collect()))


def test_lookups_by_index_equal_lookups_after_the_fold(spark):
    root = work_folder(spark, "index-test")
    batches = [
        [observation(1, "9780000000019", 0, "One", "Ana", words=["red", "old"], price=5),
         observation(2, "9780000000026", 0, None, "Bo", words=["red"], price=6), observation(3, "77", 0, "Odd")],
        # The title of the second book comes later, the first book's later title loses; a short ISBN meets its full form.
        [observation(4, "978000000001", 1, "Late", "Ana Maria", words=["new"], price=7),
         observation(5, "9780000000026", 1, "Two", words=["blue"])],
        [observation(6, "9780000000033", 2, "Two", "Cy", words=["red", "blue"])],
    ]
    for batch, rows in enumerate(batches[:2]):
        S.add_books(C.merge_books(table(spark, rows)), root, batch)
        commit_batch(spark, root, batch)
    S.add_books(C.merge_books(table(spark, batches[2])), root, 2)  # written, but not published
    wishes = [
        {"title": "One"}, {"title": "Late"}, {"title": "Two"}, {"authors": "Ana Maria"}, {"authors": "Ana"},
        {"isbn": "9780000000019"}, {"isbn": "978000000001"}, {"isbn": "77"}, {"isbn": "none"}, {"keyword": "red"},
        {"keyword": "blue", "title": "Two"}, {"keyword": "new", "title": "One", "isbn": None}, {"keyword": "new", "title": "Two"},
        {"best_offer_site": "a.ro"}, {"isbn": "77", "title": "Odd"}, {"keyword": ""}, {}]
    hits = []
    for published in (2, 3):
        if published == 3:
            commit_batch(spark, root, 2)
        for wish in wishes:
            want = found(C.find_books(S.read_books(spark, root), **wish))
            assert found(S.lookup_books(spark, root, **wish)) == want, wish
            hits.append(len(want))
    assert 0 in hits and max(hits) >= 3
    # A published batch without an index: everything is folded.
    write_books(C.merge_books(table(spark, [observation(9, "9780000000040", 0, "Two")])), f"{root}/books", 3)
    commit_batch(spark, root, 3)
    assert S.lookup_books(spark, root, title="Two").count() == 3


def test_more_stems_than_conditions_hold(spark):
    root = work_folder(spark, "index-many")
    rows = [observation(i, f"978{i:010}", 0, "Same" if i % 2 else "Other", words=["w"]) for i in range(400)]
    S.add_books(C.merge_books(table(spark, rows)), root, 0)
    commit_batch(spark, root, 0)
    assert S.lookup_books(spark, root, title="Same").count() == 200
    assert S.lookup_books(spark, root, keyword="w").count() == 400


def bytes_read(spark, action):
    """Bytes that Spark's only process reads from files while ``action`` runs."""
    def total():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = total()
    action()
    return total() - before


def test_a_lookup_reads_a_small_part_of_the_table(spark):
    root = work_folder(spark, "index-bytes")
    n = 150_000  # the pages of dictionaries that a lookup reads are of the same size in any table
    name = F.sha2(F.col("id").cast("string"), 256)
    blank = spark.createDataFrame([], BOOKS)
    books = spark.range(n).select(
        F.col("id").alias("book_id"), F.format_string("978%010d", "id").alias("isbn"), name.alias("title"),
        F.concat(name, F.lit(" "), F.reverse(name)).alias("description"),
        F.array(F.substring(name, 1, 4), F.lit("common")).alias("keywords"),
        F.array(F.format_string("978%010d", "id")).alias("isbns"))
    rows = blank.unionByName(books, allowMissingColumns=True).repartition(2, F.substring("isbn", 1, 12))
    S.add_books(rows, root, 0)
    commit_batch(spark, root, 0)
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # bytes of vectored reads are not counted
    full = bytes_read(spark, lambda: C.find_books(S.read_books(spark, root), title="x").collect())
    want = books.where("id = 777").first()
    for wish in ({"isbn": want["isbn"]}, {"title": want["title"]}, {"keyword": want["keywords"][0], "title": want["title"]}):
        got = []
        part = bytes_read(spark, lambda: got.extend(S.lookup_books(spark, root, **wish).collect()))
        assert [r["book_id"] for r in got] == [777] and part <= 0.1 * full, (wish, part, full)
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")


def test_entries(spark):
    books = C.merge_books(table(spark, [observation(1, "9780000000019", 0, "One", words=["red"])]))
    want = spark.range(1).select(F.array(*[index_key(f, F.lit(v)) for f, v in (("title", "One"), ("keyword", "red"))]).alias("k"))
    assert {(r["key"], r["stem"]) for r in index_entries(books).collect()} == {(k, "978000000001") for k in want.first()["k"]}


def test_books_and_their_index_are_packed(spark):
    from pyarrow import dataset

    from shopcat.operators.catalog import upsert_books

    root = work_folder(spark, "packed")
    book = table(spark, [observation(1, "9786066733632", title="t", words=["w"])])
    S.add_books(C.merge_books(book), root, 0)
    upsert_books(spark, f"{root}/versions", book, buckets=2)
    for part in ("books/batch=0", "index/batch=0", "versions/data"):
        for file in dataset.dataset(f"{root}/{part}", format="parquet").get_fragments():
            groups = file.metadata
            assert all(groups.row_group(g).column(0).compression == "ZSTD" for g in range(groups.num_row_groups))

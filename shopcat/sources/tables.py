"""Reading pages and writing the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcat.functions.isbn import isbn_stem
from shopcat.schemas import RAW_PAGES
from shopcat.sources.encoded import decode_pages


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages as a batch table. ``retrieved_time`` is null where the table lacks it.

    An ``html`` column of bytes is decoded, with the header in ``content_type`` if there is such a column.
    """
    pages = spark.read.parquet(path)
    if dict(pages.dtypes)["html"] == "binary":
        pages = decode_pages(pages, "html", "content_type" if "content_type" in pages.columns else None)
    if "retrieved_time" not in pages.columns:
        pages = pages.withColumn("retrieved_time", F.lit(None).cast("timestamp"))
    return pages.select("page_id", "url", "html", F.col("retrieved_time").cast("timestamp"))


def stream_pages(
    spark: SparkSession, path: str, schema: str = RAW_PAGES, max_files: int = 1000, **options: str,
) -> DataFrame:
    """Fetched pages as a stream over new parquet files, ``max_files`` per batch."""
    return (
        spark.readStream.schema(schema).options(maxFilesPerTrigger=max_files, **options).parquet(path)
    )


PAGE_ROWS = 1000  # rows of a Parquet page of tables for lookups: what a lookup of one key reads, by the column index

SPREAD_ROWS = 1_000_000  # rows of a partition of a table that is spread


def spread(table: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Give a table at least one partition per core, and one for each ``rows`` rows, before work that is heavy per row.

    A table that is read in enough parts already is returned as it is: no row is moved, and rows that lie together stay
    together. Rows are counted by part of the scan, which reads footers only.
    """
    spark = table.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, table.inputFiles()
    if len(files) >= cores:
        return table
    part = ("_metadata.file_path", "_metadata.file_block_start")
    parts = spark.read.parquet(*files).groupBy(*part).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    wanted = max(cores, -(-parts["rows"] // rows))
    return table if parts["most"] * wanted <= 2 * parts["rows"] else table.repartition(wanted)


def write_offers(offers: DataFrame, path: str, batch: str | int) -> None:
    """Write offers as one batch. Writing the same batch again replaces it.

    The rebalance hint keeps a site's rows together, splits a busy site over several files and packs small
    ones into one; rows are sorted by site, so a lookup by site skips row groups by their statistics.
    """
    (
        offers.hint("rebalance", "site").sortWithinPartitions("site", "retrieved_time")
        .write.mode("overwrite").parquet(f"{path}/batch={batch}")
    )


def write_books(books: DataFrame, path: str, batch: str | int) -> None:
    """Write catalog rows as one batch; the books of several batches fold with ``compact_books``.

    Rows carry their ISBN stem and are sorted by it, so a lookup by stem reads few pages of a file.
    """
    rows = books.withColumn("stem", isbn_stem(F.col("isbn"))).sortWithinPartitions("stem")
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(
        f"{path}/batch={batch}")


def write_index(entries: DataFrame, path: str, batch: str | int) -> None:
    """Write index entries (key, stem) as one batch, sorted by key; a key of very many books fills several files.

    Keys are hashes, so a dictionary would hold nearly all of them, and every lookup would read it.
    """
    rows = entries.hint("rebalance", "key").sortWithinPartitions("key")
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "false").option(
        "parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/batch={batch}")


def write_frontier(frontier: DataFrame, path: str, batch: str | int) -> None:
    """Write frontier rows as one batch, sorted by domain."""
    (
        frontier.hint("rebalance", "domain").sortWithinPartitions("domain", "url")
        .write.mode("overwrite").parquet(f"{path}/batch={batch}")
    )


def file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    system, found = file_system(spark, path)
    return system.exists(found)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, found = file_system(spark, path)
    return system.getFileStatus(found).isDirectory()


def commit_batch(spark: SparkSession, root: str, batch: int) -> None:
    """Publish a batch: readers see its rows in all tables of ``root`` from now on, and not before."""
    spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).write.mode("overwrite").parquet(
        f"{root}/commits/id={batch}")


def is_committed(spark: SparkSession, root: str, batch: int) -> bool:
    return path_exists(spark, f"{root}/commits/id={batch}/_SUCCESS")


def batches_of(spark: SparkSession, path: str, prefix: str = "batch=") -> set[int]:
    """The batches that have a folder under ``path``."""
    system, found = file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(found)] if system.exists(found) else []
    return {int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)}


def last_committed(spark: SparkSession, root: str) -> int | None:
    """The highest published batch."""
    if not path_exists(spark, f"{root}/commits"):
        return None
    return spark.read.schema("batch bigint").parquet(f"{root}/commits/id=*").agg(F.max("batch")).first()[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no reader needs any more."""
    system, found = file_system(spark, path)
    system.delete(found, True)


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All batches of a table written by the functions above; ``batch`` is a partition column.

    With a schema, a table that has no file yet is empty.
    """
    if schema is None:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    full = f"{schema}, batch bigint"
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def read_committed(spark: SparkSession, root: str, table: str, schema: str, keep_batch: bool = False) -> DataFrame:
    """The rows of a table in published batches only; the batch filter prunes folders."""
    if not path_exists(spark, f"{root}/commits"):
        rows = read_batches(spark, f"{root}/commits", schema)
    else:
        done = spark.read.schema("batch bigint").parquet(f"{root}/commits/id=*")
        rows = read_batches(spark, f"{root}/{table}", schema).join(done, "batch", "left_semi")
    return rows if keep_batch else rows.drop("batch")

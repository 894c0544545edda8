"""Statistics of running jobs: a row after every so many pages of a job, kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shopcat.operators.jobs import BATCH_SIZE, count_pages, number_pages, running_counts
from shopcat.sources.tables import commit_batch, is_committed, last_committed, read_committed, remove

REQUESTED = "job_id string, requested_at timestamp, page_id bigint, attempts bigint, reached boolean, type string"
_COUNTS = "job_id string, block int, pages bigint, requests bigint, reached bigint, pairs bigint"
_CARRY = "job_id string, pages bigint"
_SEEN = "latest timestamp"


def _state(spark: SparkSession, root: str, name: str, batch: int | None, schema: str) -> DataFrame:
    """A table as the batch left it; empty before the first one."""
    if batch is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}/batch={batch}")


def run_job_statistics(requested: DataFrame, root: str, n: int = BATCH_SIZE, late: str = "0 seconds",
                       trigger: dict | None = None) -> StreamingQuery:
    """Count the pages of running jobs from a stream, in blocks of ``n`` in the order of their request.

    ``requested`` is as :func:`shopcat.operators.jobs.batch_stats` takes it. A page is counted once no page requested
    before it is expected: when the latest request seen is ``late`` after its own. Until then it waits in a
    table. A page that comes later than that is counted when it comes, so none is lost; with pages late
    by at most ``late`` the blocks are those of ``batch_stats`` over all pages, whatever files they come in.

    A micro-batch sorts the pages to be counted by a range shuffle, which splits a job of any size, and adds to them what
    the batches before have counted: one row per job. It writes its own counts, the new number of pages
    per job and the pages that wait, and publishes all of them at once; a batch that is run again replaces what
    it wrote before. Work and storage follow the batch and the pages that wait, not the length of the jobs.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, root, batch_id):
            return
        before = last_committed(spark, root)
        arrived = f"{root}/arrived/batch={batch_id}"
        waiting = _state(spark, root, "waiting", before, REQUESTED)
        batch.select(*waiting.columns).unionByName(waiting).write.mode("overwrite").parquet(arrived)
        rows = spark.read.schema(REQUESTED).parquet(arrived)
        seen = _state(spark, root, "seen", before, _SEEN).unionByName(rows.select(F.col("requested_at").alias("latest")))
        latest = seen.agg(F.max("latest").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{root}/seen/batch={batch_id}")
        horizon = latest.select(F.expr(f"latest - interval {late}").alias("h")).first()["h"]
        waits = F.col("requested_at") > F.lit(horizon).cast("timestamp")
        ready = rows.where(F.coalesce(~waits, F.lit(True)))
        carry = _state(spark, root, "carry", before, _CARRY)
        counts = count_pages(number_pages(ready, carry), n).withColumnRenamed("batch", "block")
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
        mine = spark.read.schema(_COUNTS).parquet(f"{root}/counts/batch={batch_id}").select("job_id", "pages")
        carry.unionByName(mine).groupBy("job_id").agg(F.sum("pages").alias("pages")).write.mode("overwrite").parquet(
            f"{root}/carry/batch={batch_id}")
        rows.where(waits).write.mode("overwrite").parquet(f"{root}/waiting/batch={batch_id}")
        commit_batch(spark, root, batch_id)
        remove(spark, arrived)
        for name in ("waiting", "carry", "seen") if before is not None and before > 0 else ():
            remove(spark, f"{root}/{name}/batch={before - 1}")  # readers may still be at the batch before

    return requested.writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def read_job_statistics(spark: SparkSession, root: str, n: int = BATCH_SIZE) -> DataFrame:
    """The rows of ``batch_stats`` over all pages so far, and whether a block is ``complete``.

    Pages that wait are counted behind the others. They are not final, so a block that holds any is not complete.
    """
    done = read_committed(spark, root, "counts", _COUNTS).withColumn("final", F.col("pages"))
    at = last_committed(spark, root)
    waiting = number_pages(_state(spark, root, "waiting", at, REQUESTED), _state(spark, root, "carry", at, _CARRY))
    more = count_pages(waiting, n).withColumnRenamed("batch", "block").withColumn("final", F.lit(0).cast("bigint"))
    sums = done.unionByName(more).groupBy("job_id", F.col("block").alias("batch")).agg(
        *[F.sum(c).alias(c) for c in ("pages", "requests", "reached", "pairs", "final")])
    return running_counts(sums, (F.col("final") == n).alias("complete"))

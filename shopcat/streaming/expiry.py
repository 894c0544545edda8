"""Current offers on a stream: the latest one per key, gone when it has not been seen again for a while."""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, IntegralType, StringType, StructType, TimestampType

from shopcat.session import rocksdb_state
from shopcat.sources.tables import commit_batch, is_committed, read_committed

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa

# The processor travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 18  # rows of a task that are compared before they move
GROUPS = 4096  # of keys, each with one state and one timer; a checkpoint holds for the number it was written with

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class LatestUntilExpiry(StatefulProcessor):
    """State of a group of keys: the latest row of each, and one timer at the first time in event time at which one of
    them has been there for ``ttl_ms``.

    A newer row replaces the one of its key and is emitted. When the watermark passes the timer, the rows whose time is over
    go and are emitted once more as expired, and the timer moves on. So the store holds the keys seen within the
    time to live (and the allowed lateness), not every key ever seen. Keys share groups since every call to the
    store is a message between processes: there are a few for each group and batch, however many keys.
    """

    def __init__(self, numbers: list[bool], ttl_ms: int):
        self.numbers, self.ttl_ms = numbers, ttl_ms
        self.order = [f"latest_o{k}" for k in range(len(numbers))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "packed binary")

    def rank(self, row: tuple) -> tuple:
        """What a row (key, time, order columns.., payload) is compared by: its time, then the order, null before all else."""
        return (row[1], *((v is not None, (int(v) if number else v) if v is not None else 0)
                          for v, number in zip(row[2:], self.numbers)))

    def handleInputRows(self, key: tuple, rows: Iterator["pd.DataFrame"], timerValues) -> Iterator["pd.DataFrame"]:
        held = self.load()
        due, changed = self.due(held), set()
        for part in rows:
            for row in zip(*(part[c].tolist() for c in ("latest_key", "latest_us", *self.order, "payload"))):
                best = held.get(row[0])
                if best is None or row[1] > best[1] or (row[1] == best[1] and self.rank(row) > self.rank(best)):
                    held[row[0]] = row
                    changed.add(row[0])
        if changed:
            self.keep(held, due)
            yield self.out([held[k] for k in changed], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator["pd.DataFrame"]:
        held, now = self.load(), timerValues.getCurrentWatermarkInMs()
        over = [k for k, row in held.items() if self.expiry(row) <= now]
        rows = [held.pop(k) for k in over]
        self.keep(held, None)
        if rows:
            yield self.out(rows, True)

    def load(self) -> dict[str, tuple]:
        packed = self.latest.get()
        return {} if packed is None else {row[0]: tuple(row) for row in json.loads(zlib.decompress(packed[0]))}

    def keep(self, held: dict[str, tuple], timer: int | None) -> None:
        """Store the rows of a group, and move its timer, which is at ``timer``."""
        due = self.due(held)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if held:
            self.latest.update((zlib.compress(json.dumps(list(held.values())).encode(), 1),))
        else:
            self.latest.clear()

    def due(self, held: dict[str, tuple]) -> int | None:
        return min(map(self.expiry, held.values()), default=None)

    def expiry(self, row: tuple) -> int:
        return row[1] // 1000 + self.ttl_ms

    def out(self, rows: list[tuple], expired: bool) -> "pd.DataFrame":
        import pandas as pd

        return pd.DataFrame({"latest_key": [r[0] for r in rows], "latest_us": [r[1] for r in rows],
                             "payload": [r[-1] for r in rows], "expired": expired})

    def close(self) -> None:
        pass


def latest_of_task(batches: Iterator["pa.RecordBatch"]) -> Iterator["pa.RecordBatch"]:
    """Rows (latest_key, latest_us, ..) without those that a later one of the same key and task makes void.

    Rows are held up to ``HELD``; equal times are all kept. What leaves here is what moves and goes through the state.
    """
    import numpy as np
    import pyarrow as pa

    def reduced(rows: "pa.Table") -> "pa.Table":
        keys = rows.column("latest_key").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        times = rows.column("latest_us").to_numpy()
        last = np.full(int(keys.max()) + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, keys, times)
        return rows.filter(pa.array(times == last[keys]))

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            rows = reduced(pa.Table.from_batches(held))
            held, n = rows.to_batches(), rows.num_rows
            if n > HELD // 2:
                yield from held
                held, n = [], 0
    if held:
        yield from reduced(pa.Table.from_batches(held)).to_batches()


def _sortable(column: Column, kind: DataType) -> tuple[Column, bool]:
    """A column as text, and whether the text is a number."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("string"), True
    if isinstance(kind, IntegralType | StringType):
        return column.cast("string"), isinstance(kind, IntegralType)
    raise TypeError(f"offers can't be ordered by {kind.simpleString()}")


def milliseconds(spark: SparkSession, interval: str) -> int:
    """An interval such as ``30 days 1 hour`` in milliseconds."""
    return spark.range(1).select(
        F.expr(f"unix_millis(timestamp_millis(0) + interval {interval})")).first()[0]


def stream_current_offers(offers: DataFrame, *keys: str, ttl: str, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Changes of the latest offer per key on a stream: (keys.., best_offer, expires_at, expired), append mode.

    ``offers`` has ``offer`` (with ``retrieved_time``) and ``seq``, a struct of whole numbers, times and strings that
    decides between equal times. An offer is gone when the watermark, the latest time seen less ``late``, has
    passed its time plus ``ttl``: then a row with ``expired`` tells so. Offers that come more than
    ``late`` after the latest one are not read; the engine counts them as dropped by the watermark. Null offers and
    offers without a time change nothing. State is kept by ``groups`` groups of keys and needs the RocksDB store:
    :func:`run_current_offers` sets it.
    """
    spark = offers.sparkSession
    kinds = offers.schema["seq"].dataType
    order = [_sortable(F.col("seq")[f.name], f.dataType) for f in kinds.fields]
    types = dict(offers.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows = offers.where("offer.retrieved_time IS NOT NULL").select(
        F.to_json(F.struct(*keys), _JSON).alias("latest_key"), F.unix_micros("offer.retrieved_time").alias("latest_us"), "offer", "seq")
    rows = rows.mapInArrow(latest_of_task, rows.schema).select(
        F.pmod(F.xxhash64("latest_key"), F.lit(groups)).cast("int").alias("latest_group"), "latest_key", "latest_us",
        F.col("offer.retrieved_time").alias("latest_time"), *[c.alias(f"latest_o{k}") for k, (c, _) in enumerate(order)],
        F.to_json("offer", _JSON).alias("payload"),
    ).withWatermark("latest_time", late)
    ttl_ms = milliseconds(spark, ttl)
    changes = rows.groupBy("latest_group").transformWithStateInPandas(
        LatestUntilExpiry([number for _, number in order], ttl_ms),
        "latest_key string, latest_us long, payload string, expired boolean", "append", "EventTime")
    return changes.withColumn("latest_key", F.from_json("latest_key", named, _JSON)).select(
        *[F.col("latest_key")[k].alias(k) for k in keys],
        F.from_json("payload", offers.schema["offer"].dataType, _JSON).alias("best_offer"),
        F.timestamp_micros(F.col("latest_us") + ttl_ms * 1000).alias("expires_at"), "expired")


def run_current_offers(offers: DataFrame, root: str, *keys: str, ttl: str, late: str = "0 seconds",
                       trigger: dict | None = None) -> StreamingQuery:
    """Keep the changes of :func:`stream_current_offers` under ``root``, one published batch per micro-batch."""
    changes = stream_current_offers(offers, *keys, ttl=ttl, late=late)

    def keep(batch: DataFrame, batch_id: int) -> None:
        if not is_committed(batch.sparkSession, root, batch_id):
            batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
            commit_batch(batch.sparkSession, root, batch_id)

    with rocksdb_state(offers.sparkSession):
        return changes.writeStream.foreachBatch(keep).outputMode("append").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def read_current_offers(spark: SparkSession, root: str, *keys: str, schema: StructType | str) -> DataFrame:
    """(keys.., best_offer, expires_at) of the offers that have not expired, over all published batches.

    ``schema`` is that of :func:`stream_current_offers`. A key's last change counts. Within a batch an expiry comes
    after the change that set its time.
    """
    names = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    rows = read_committed(spark, root, "changes", names, keep_batch=True)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("best_offer", "expires_at", "expired"), F.struct("batch", "expired")).alias("l"))
    return last.where("NOT l.expired").select(*keys, "l.best_offer", "l.expires_at")

"""Incremental parts as Structured Streaming: activity counters, ingest, dirty volumes, rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def activity(events: DataFrame, page: str = "user_id", ts: str = "ts") -> DataFrame:
    """(page_id, query_hit_count, last_query_at) of an event stream or table."""
    return events.groupBy(F.col(page).alias("page_id")).agg(F.count("*").alias("query_hit_count"), F.max(ts).alias("last_query_at"))


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain a bounded source and return the state as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def read_events(spark: SparkSession, folder: str, table: str = "events", per_trigger: int = 1) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    static = spark.read.parquet(f"{folder}/{table}.parquet")
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{table}.parquet*")


def ingest_batches(docs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each batch of new documents to ``handle`` once; the checkpoint makes a restart go on where it was."""
    q = docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def limited(events: DataFrame, key: str, ts: str, value: str, every_s: float = 5.0) -> DataFrame:
    """At most one message per key and ``every_s`` seconds of event time, in time order; the state is one time a key.

    For a stream (applyInPandasWithState) the messages of a batch are ordered within it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def one(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "value"])
        keep = []
        for t in rows["ts"]:
            s = t.timestamp()
            keep.append(last is None or s - last >= every_s)
            if keep[-1]:
                last = s
        if last is not None:
            state.update((last,))
        yield rows[keep].assign(key=k[0])[["key", "ts", "value"]]

    own = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("string").alias("value"))
    return own.groupBy("key").applyInPandasWithState(one, "key string, ts timestamp, value string", "last double", "append", GroupStateTimeout.NoTimeout)


class Broadcaster:
    """Bounded queue of probes for a transport: drop-oldest at ``size``, one message each ``every_s`` seconds."""

    def __init__(self, send: Callable[[object], None], size: int = 100, every_s: float = 5.0):
        self.send, self.every_s = send, every_s
        self._queue: deque = deque(maxlen=size)
        self._last: float | None = None

    def push(self, probe: object) -> None:
        self._queue.append(probe)

    def __len__(self) -> int:
        return len(self._queue)

    def tick(self, now: float) -> bool:
        """Send the oldest message if the interval has passed."""
        if not self._queue or (self._last is not None and now - self._last < self.every_s):
            return False
        self.send(self._queue.popleft())
        self._last = now
        return True

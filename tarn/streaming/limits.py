"""Streams of requests and flags: rate limits, duplicates, incremental and resumable processing.

Every operator takes a streaming or a batch DataFrame of events with a time column; on a stream, state is kept as long as the
watermark says and no longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECISIONS = "key string, at timestamp, allowed boolean, used int, retry_after int"


def limited(events: DataFrame, key: str, at: str, most: Column, seconds: int) -> DataFrame:
    """For a batch: how many events of the key lie in the window of that many seconds up to each event, itself included, and
    whether that is within ``most``.  Every event counts, allowed or not.  A key's events are ordered in one partition."""
    window = W.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("used", F.count("*").over(window)).withColumn("allowed", F.col("used") <= most)


def limit_stream(events: DataFrame, key: str, at: str, most: int, seconds: int, delay: str = "2 minutes") -> DataFrame:
    """For a stream: each event with whether fewer than ``most`` allowed events of the key lie in the window before it, and in how
    many seconds the oldest of these leaves it.  State holds the times of a key's allowed events in the window only."""

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = []
        for now in sorted(t for batch in batches for t in batch["at"]):  # a key's events of one trigger, in whatever batches they come
            stamp = now.timestamp()
            times = [t for t in times if t > stamp - seconds]
            allowed = len(times) < most
            if allowed:
                times.append(stamp)
            rows.append((keys[0], now, allowed, len(times), 0 if allowed else int(times[0] + seconds - stamp) + 1))
        yield pd.DataFrame(rows, columns=["key", "at", "allowed", "used", "retry_after"])
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at")).withWatermark("at", delay)
    return keyed.groupBy("key").applyInPandasWithState(decide, DECISIONS, "times array<double>", "append", "EventTimeTimeout")


def first_within(events: DataFrame, keys: list[str], at: str, hours: int, order: str) -> DataFrame:
    """For a batch: the events that no event of the same keys precedes within that many hours, refused ones included; ties by
    ``order``."""
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(at, order))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(at) - F.col("_before") > F.expr(f"INTERVAL {hours} HOURS"))).drop("_before")


def distinct_stream(events: DataFrame, keys: list[str], at: str, within: str = "24 hours") -> DataFrame:
    """For a stream: the first event of the same keys; its keys are forgotten when the watermark has passed it by ``within``."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def counted_stream(events: DataFrame, key: str, at: str, window: str, delay: str) -> DataFrame:
    """Events by key in windows of event time; a window is final when the watermark has passed it."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))


def high_water(rows: DataFrame, stamp: str, last: object) -> tuple[DataFrame, object]:
    """The rows changed after the last mark, and the new mark: their latest time, or the old one where there are none."""
    changed = rows if last is None else rows.filter(F.col(stamp) > F.lit(last))
    newest = changed.agg(F.max(stamp)).first()[0]
    return changed, last if newest is None else newest


def resume(todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], batch: int, order: list[Column]) -> int:
    """Works off what is not yet in the results at ``path``, ``batch`` rows at a time, and appends each batch's results; a run
    that was cut off goes on where the last whole batch ended.  Returns how many rows were worked.

    ``work`` keeps the key; a batch is appended by one committed write, so none is there in part.
    """
    from tarn.operators.selection import unprocessed

    spark, worked = todo.sparkSession, 0
    while True:
        try:
            done = spark.read.parquet(path).select(key)
        except Exception as e:  # noqa: BLE001  the first run has no results
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = todo.select(key).limit(0)
        rows = unprocessed(todo, done, key, order, batch)
        n = rows.count()
        if not n:
            return worked
        work(rows).write.mode("append").parquet(path)
        worked += n


def drained(stream: DataFrame, checkpoint: str, table: str, timeout: float | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a table in memory, and returns that table (for bounded inputs and tests).  With
    a ``timeout`` in seconds a stream that has not come to its end by then is stopped, which is an error."""
    query = stream.writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"the stream was still running after {timeout} s")
    return stream.sparkSession.table(table)

"""Streams over files held against what the batches say, and processing that goes on where it was cut off."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tarn.streaming import limits

SCHEMA = "who string, at timestamp, n int"
START = datetime.datetime(2024, 1, 1, 12)


def events(spark, path, batches):
    seen = set()
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(w, START + datetime.timedelta(seconds=s), n) for w, s, n in rows], SCHEMA)
        made.coalesce(1).write.mode("append").parquet(str(path))
        for file in set(path.glob("*.parquet")) - seen:  # files are read in the order of their times
            os.utime(file, (1_700_000_000 + 10 * k,) * 2)
            seen.add(file)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_limit_stream_counts_allowed_events_across_batches(spark, tmp_path):
    stream = events(spark, tmp_path / "in", [[("a", 0, 1), ("a", 10, 2), ("b", 11, 3)], [("a", 20, 4), ("a", 61, 5), ("b", 12, 6)], [("a", 69, 7), ("a", 72, 8)]])
    out = limits.drained(limits.limit_stream(stream, "who", "at", 2, 60), str(tmp_path / "checkpoint"), "limited")
    got = sorted((r.key, int((r.at - START).total_seconds()), r.allowed, r.retry_after) for r in out.collect())
    # 20 is refused (0 and 10 are in its window); 61 is allowed (0 has left); 69 is refused (10 and 61); 72 is allowed (10 has left)
    assert got == [("a", 0, True, 0), ("a", 10, True, 0), ("a", 20, False, 41), ("a", 61, True, 0), ("a", 69, False, 2), ("a", 72, True, 0), ("b", 11, True, 0), ("b", 12, True, 0)]


def test_limit_stream_in_the_order_of_time_whatever_the_batches(spark, tmp_path):
    """Two rows an Arrow batch: later events come first, and all but the earliest two are refused."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = events(spark, tmp_path / "in", [[("a", s, s) for s in (50, 40, 30, 20, 10, 0)]])
        out = limits.drained(limits.limit_stream(stream, "who", "at", 2, 60), str(tmp_path / "checkpoint"), "small_batches")
        assert sorted(int((r.at - START).total_seconds()) for r in out.filter("allowed").collect()) == [0, 10]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_stream_that_takes_too_long_is_an_error(spark, tmp_path):
    stream = events(spark, tmp_path / "in", [[("a", 0, 1)], [("a", 1, 1)]])
    slow = stream.withColumn("n", F.expr("n + cast(reflect('java.lang.Thread', 'sleep', 3000L) is null as int)"))
    with pytest.raises(TimeoutError):
        limits.drained(slow, str(tmp_path / "checkpoint"), "slow", 1.0)


def test_duplicates_within_a_day(spark, tmp_path):
    stream = events(spark, tmp_path / "in", [[("a", 0, 1), ("b", 1, 1)], [("a", 3600, 1), ("a", 3600, 2)]])
    out = limits.drained(limits.distinct_stream(stream, ["who", "n"], "at"), str(tmp_path / "checkpoint"), "distinct")
    assert sorted((r.who, r.n) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_windows_are_final_behind_the_watermark(spark, tmp_path):
    stream = events(spark, tmp_path / "in", [[("a", 0, 1), ("a", 30, 1), ("b", 59, 1)], [("a", 200, 1)], [("c", 210, 1)], [("a", 10, 1), ("a", 400, 1)]])
    out = limits.drained(limits.counted_stream(stream, "who", "at", "1 minute", "30 seconds"), str(tmp_path / "checkpoint"), "counted")
    got = {(r.who, int((r.window.start - START).total_seconds())): r.n for r in out.collect()}
    assert got == {("a", 0): 2, ("b", 0): 1, ("a", 180): 1, ("c", 180): 1}  # the late event at 10 is not counted


def test_resume_goes_on_behind_the_last_whole_batch(spark, tmp_path):
    todo = spark.range(10).withColumnRenamed("id", "k")
    path, calls = str(tmp_path / "out"), []

    def work(rows):
        calls.append(sorted(r.k for r in rows.collect()))
        if len(calls) == 3:
            raise RuntimeError("cut off")
        return rows.withColumn("v", F.col("k") * 2)

    with pytest.raises(RuntimeError):
        limits.resume(todo, "k", path, work, 4, [F.col("k")])
    assert calls == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert limits.resume(todo, "k", path, work, 4, [F.col("k")]) == 2
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {k: 2 * k for k in range(10)}
    assert limits.resume(todo, "k", path, work, 4, [F.col("k")]) == 0


def test_high_water_mark_of_an_empty_pull(spark):
    rows = spark.createDataFrame([("a", START, 1)], SCHEMA)
    changed, mark = limits.high_water(rows, "at", START)
    assert changed.count() == 0 and mark == START
    assert limits.high_water(rows, "at", None)[1] == START

"""Sets of tables that change together: readers see the whole old set or the whole new one.

Every table of a new version is written to a folder of its own.  Only when all of them are there is a small state file with the
next number put in place, by a rename that fails where the number is taken; it names the folder of every table.  A job that
stops before that leaves folders which no state names, and readers go on with the state before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


def _files(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest state; 0 and nothing where there is none."""
    at, files = _files(spark, folder)
    if not files.exists(at):
        return 0, {}
    numbers = [int(n[6:-5]) for n in (s.getPath().getName() for s in files.listStatus(at)) if n.startswith("state-") and n.endswith(".json")]
    if not numbers:
        return 0, {}
    lines = spark.read.text(f"{folder}/state-{max(numbers):09d}.json", wholetext=True).collect()
    return max(numbers), json.loads(lines[0][0])


def commit(spark: SparkSession, folder: str, after: int, state: dict) -> int:
    """Puts the state in place as the one behind ``after``."""
    at, files = _files(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files.mkdirs(at)
    waiting = path(at, f"_waiting-{uuid.uuid4().hex}")
    out = files.create(waiting, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    target = path(at, f"state-{after + 1:09d}.json")
    if files.exists(target) or not files.rename(waiting, target):
        files.delete(waiting, False)
        raise Conflict(f"version {after + 1} of {folder} is there already")
    return after + 1


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest version."""
    return spark.read.parquet(current(spark, folder)[1]["tables"][name])


def replace(spark: SparkSession, folder: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> int:
    """Replaces these tables together; others of the set stay as they are.  ``check`` sees the tables as written and may raise."""
    number, state = current(spark, folder)
    written = {}
    for name, df in tables.items():
        written[name] = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(written[name])
    if check:
        check({name: spark.read.parquet(path) for name, path in written.items()})
    return commit(spark, folder, number, {**state, "tables": {**state.get("tables", {}), **written}})


def rebuild_kind(spark: SparkSession, folder: str, name: str, rows: DataFrame, kind: str, value: str, details: tuple[str, str, str]) -> int:
    """The rows of one kind are wiped and come anew, with what hangs on them: ``details`` is a table, its column of the parent's id
    and the id's column in ``name``; its rows that point at a wiped row which does not come again go too."""
    table, points, id = details
    old, hanging = read(spark, folder, name), read(spark, folder, table)
    kept = old.filter(~F.col(kind).eqNullSafe(F.lit(value))).unionByName(rows)
    gone = old.filter(F.col(kind) == value).select(F.col(id).alias(points)).join(rows.select(F.col(id).alias(points)), points, "left_anti")
    return replace(spark, folder, {name: kept, table: hanging.join(gone, points, "left_anti").select(*hanging.columns)})


def with_parents(rows: DataFrame, key: str, parent_key: str, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Adds the parent's new id, found by its natural key once all rows have theirs; an unknown parent is null, of equal keys the
    least id counts."""
    known = rows.groupBy(F.col(key).alias(parent_key)).agg(F.min(id).alias(parent))
    return rows.join(known, parent_key, "left")

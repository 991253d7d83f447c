"""Tables between two steps, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder.  On a cluster that would be the driver's own
    disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes the table, in folders by the values of ``by`` where given, and reads it again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path)
    order = [f for f in df.schema if f.name not in (by or [])] + [f for f in df.schema if f.name in (by or [])]
    out = df.sparkSession.read.schema(type(df.schema)(order)).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``stored`` that nothing will read again."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

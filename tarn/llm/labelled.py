"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """Rows kept out of every fit: crc32 of the key as text leaves 2 when divided by 4.  A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_text and _label of at most ``rows`` labelled documents outside the held-out fold.

    The sample is the ``rows`` labels least by a hash of the key: the same rows whatever the partitions.  Only keys and
    labels are ordered; the texts come by a join with that bounded list.  Rows with a null key or label are left out, and of
    repeated keys one label and one text count: the greatest label and the text whose hash is least.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = usable.orderBy(F.xxhash64(key), key).limit(rows)
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen.withColumnRenamed(key, "_key")), "_key")
    return found.groupBy("_key", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_key", "_text", "_label")

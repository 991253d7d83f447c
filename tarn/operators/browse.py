"""Filters, facets, paging, rankings and distributions over browsable relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """The rows that meet every predicate given; None stands for one that was not asked for."""
    asked = [p for p in predicates if p is not None]
    return df.filter(reduce(Column.__and__, asked)) if asked else df


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive contains over several columns; the text has no wildcards."""
    return reduce(Column.__or__, (F.lower(c).contains(text.lower()) for c in columns))


def array_contains_text(column: str, text: str) -> Column:
    """Whether some element contains the text, in any case."""
    return F.exists(column, lambda x: F.lower(x).contains(text.lower()))


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """One page: limit is held between 1 and ``most``, offset at 0 or more.  ``order`` must end in a key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def facet(df: DataFrame, column: str | Column, name: str, top: int | None = None) -> DataFrame:
    """Values with their row counts, most frequent first; ties by value."""
    counted = df.groupBy((F.col(column) if isinstance(column, str) else column).alias(name)).agg(F.count("*").alias("n")).filter(F.col(name).isNotNull())
    return counted.orderBy(F.desc("n"), name).limit(top) if top else counted


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of every group; Spark prunes each partition before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of every group."""
    return top_per_group(df, by, order, 1, "_rn").drop("_rn")


def most_common(df: DataFrame, key: str, value: str, default: str = "Other") -> DataFrame:
    """Per key the value it has most often (ties: the lesser value); keys with only nulls get the default."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))
    return df.select(key).distinct().join(best, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def proportional_pages(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """Splits a page over collections in proportion to their counts, at least one row for each that has any."""
    total = F.sum(n).over(W.partitionBy())  # one row a collection
    share = F.greatest(F.lit(1), F.round(F.lit(limit) * F.col(n) / total)).cast("int")
    return counts.withColumn("page_rows", F.when(F.col(n) > 0, share).otherwise(0))


def lineage(nodes: DataFrame, id: str, parent: str, depth: int = 6) -> DataFrame:
    """(leaf, ancestor, depth) up to ``depth`` levels above; a join for each level, and a cycle ends at the depth."""
    step = nodes.select(F.col(id).alias("_child"), F.col(parent).alias("_parent")).filter("_parent is not null")
    level = nodes.select(F.col(id).alias("leaf"), F.col(id).alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth):
        level = level.join(step, F.col("ancestor") == F.col("_child")).select("leaf", F.col("_parent").alias("ancestor"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def coverage(branches: dict[str, DataFrame], has: Column) -> DataFrame:
    """Per branch how many rows there are and how many have something."""
    rows = [df.select(F.lit(name).alias("collection"), has.alias("_has")) for name, df in branches.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("collection").agg(F.count("*").alias("total"), F.count_if("_has").alias("present"))

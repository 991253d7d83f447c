"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.storage import discard, stored

HUBS = 1000


def hub_join(left: DataFrame, right: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``left`` joined with ``right`` by ``key``, no key's rows gathered in one task.

    ``right`` has one row for each key and in ``n`` how many rows of ``left`` the key has; ``total`` is at least their number.
    Keys with more than one in HUBS of the rows, so fewer than HUBS keys, are broadcast; the others are dealt by key.
    """
    hubs = F.broadcast(right.filter(F.col(n) * HUBS > total))
    rest = left.join(hubs.select(key), key, "left_anti").join(right.filter(F.col(n) * HUBS <= total), key)
    return left.join(hubs, key).unionByName(rest)


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every edge with the least v among the edges of its u."""
    return hub_join(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.  Nulls and loops are no edges.

    Each round is two aggregations and two joins on node ids; no neighbourhood is gathered in a row or, for the nodes with
    the most edges, in a task.  Rounds go on until no edge changes; a round's edges replace those of the one before.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct()
    pair, before = stored(pair, "edges"), None
    while True:
        n, *state = pair.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, *state) == before:
            break
        before = (n, *state)
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", "m")
        large = _with_least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), least.alias("v")).filter("u > v").distinct()
        known = _with_least(large, 2 * n)
        small = known.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v")))
        after = stored(small.filter("u > v").distinct(), "edges")
        discard(pair)
        pair = after
    inner = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.union(pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

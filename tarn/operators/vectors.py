"""Vector operators: cosine search, similarity graphs, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, k: int = 15, over: float = 0.3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to the one query row, of those over the limit (rounded to three places first)."""
    one = query.select(F.col(key).alias("_q"), F.col(vector).alias("_v")).limit(1)
    scored = vectors.join(F.broadcast(one), F.col(key) != F.col("_q")).withColumn("similarity", F.round(cosine(F.col(vector), F.col("_v")), 3))
    return scored.filter(F.col("similarity") > over).orderBy(F.desc("similarity"), key).limit(k).select(key, "similarity")


def similar_pairs(vectors: DataFrame, over: float, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs at least ``over`` similar.

    Exact: rows are dealt into blocks of bounded size by a hash, every pair of blocks is one unit of work, and a unit is one
    matrix product.  The number of units follows from the count of rows.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    units = dealt.select("id", "v", "own", other).select("id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        x, ids, own = x[norm > 0] / norm[norm > 0, None], pdf["id"].to_numpy()[norm > 0], pdf["own"].to_numpy()[norm > 0]
        left, right = (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        i, j = np.nonzero(x[left] @ x[right].T >= over)
        i, j = left[i], right[j]
        keep = ids[i] < ids[j] if lo == hi else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "similarity": (x[i] * x[j]).sum(axis=1)})

    return units.groupBy("lo", "hi").applyInPandas(work, "a long, b long, similarity double")


def closest_to_centroid(vectors: DataFrame, group: str, k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per group the k rows most similar to its mean vector."""
    from tarn.operators.browse import top_per_group

    parts = vectors.select(group, F.posexplode(vector).alias("i", "x"))
    mean = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_c"))
    scored = vectors.join(mean, group).withColumn("similarity", F.round(cosine(F.col(vector), F.col("_c")), 6))
    return top_per_group(scored, [group], [F.desc("similarity"), F.col(key)], k).select(group, key, "similarity", "rn")


def greedy_clusters(vectors: DataFrame, group: str, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy centroid clusters within each group, in key order: a row joins the most similar cluster at or over the threshold
    and moves its centroid, else opens one.

    Sequential by definition, so groups are the unit of parallelism.  Rows come sorted and are streamed; a task holds one
    batch and the centroids of the open group.
    """
    kinds = dict(vectors.dtypes)
    ordered = vectors.select(group, key, vector).repartition(group).sortWithinPartitions(group, key)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, norms = None, np.zeros((0, 0)), np.zeros(0)
        for batch in batches:
            out = []
            for own, v in zip(batch[group], batch[vector], strict=True):
                v = np.asarray(v, np.float64)
                if now is None or own != now:
                    now, sums, norms = own, np.zeros((0, len(v))), np.zeros(0)
                s = (sums @ v) / (norms * np.linalg.norm(v) + 1e-300)
                at = int(s.argmax()) if len(s) else -1
                if at >= 0 and s[at] >= threshold:
                    sums[at] += v
                    norms[at] = np.linalg.norm(sums[at])
                else:
                    at = len(sums)
                    sums, norms = np.vstack([sums, v]), np.append(norms, np.linalg.norm(v))
                out.append(at)
            yield pd.DataFrame({group: batch[group], key: batch[key], "cluster": out})

    return ordered.mapInPandas(work, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


def cluster_sweep(vectors: DataFrame, thresholds: list[float], group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per threshold: clusters, how many of them are single rows, and the largest (greedy clusters of the whole table)."""
    whole = vectors.select(F.lit(0).alias("_all"), key, vector)
    rows = []
    for t in thresholds:
        sizes = greedy_clusters(whole, "_all", t, key, vector).groupBy("cluster").agg(F.count("*").alias("n"))
        rows.append(sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singles"), F.max("n").alias("largest")).select(F.lit(t).alias("threshold"), "clusters", "singles", "largest"))
    return reduce(DataFrame.unionByName, rows)


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, over: float, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Per query row its k most similar other rows over the limit: (query, key, similarity).

    Queries and table are dealt into blocks of about ``block`` rows, and every block of queries meets every block of the table in
    a task of its own, which keeps its k best a query.  Nothing is gathered by the driver, however many queries there are, and a
    task holds two blocks.  Null and zero vectors are near to none.
    """
    kind = dict(vectors.dtypes)[key]
    use = lambda df: df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    many = lambda df: max(1, -(-df.count() // block))
    asked, known = use(queries), use(vectors)
    n_asked, n_known = many(asked), many(known)
    dealt = lambda df, n: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", F.lit(True).alias("ask"), dealt(asked, n_asked).alias("x"), every(n_known).alias("y"))
    right = known.select("id", "v", F.lit(False).alias("ask"), every(n_asked).alias("x"), dealt(known, n_known).alias("y"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(m, axis=1)
        m, ids, ask = m[norm > 0] / norm[norm > 0, None], pdf["id"].to_numpy()[norm > 0], pdf["ask"].to_numpy(bool)[norm > 0]
        s = m[ask] @ m[~ask].T
        own, other = ids[ask], ids[~ask]
        s[own[:, None] == other[None, :]] = -2
        best = np.lexsort((np.broadcast_to(other, s.shape), -np.round(s, 9)))[:, :k] if s.size else np.zeros((len(s), 0), int)
        i, j = np.repeat(np.arange(len(s)), best.shape[1]), best.reshape(-1)
        keep = s[i, j] > over
        return pd.DataFrame({"query": own[i[keep]], key: other[j[keep]], "similarity": s[i[keep], j[keep]]})

    found = left.unionByName(right).groupBy("x", "y").applyInPandas(work, f"query {kind}, {key} {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key))
    return found.withColumn("rn", rank).filter(F.col("rn") <= k)


def canonical(members: DataFrame, cluster: str, key: str, similarity: str, details: dict[str, float], year: str, default: int = 2000) -> DataFrame:
    """Per cluster the member with the best score: 0.35 of its similarity to the centroid, 0.35 of its detail (each column's share
    of the cluster's largest, at least 1, times its weight) and 0.30 of how recent it is within the cluster; ties: the least
    key."""
    over = W.partitionBy(cluster)
    detail = sum(F.col(c) / F.greatest(F.max(c).over(over), F.lit(1)) * w for c, w in details.items())
    at = F.coalesce(F.col(year), F.lit(default))
    span = F.max(at).over(over) - F.min(at).over(over)
    recent = (at - F.min(at).over(over)) / F.when(span == 0, 1).otherwise(span)
    scored = members.withColumn("score", F.col(similarity) * 0.35 + detail * 0.35 + recent * 0.30)
    return scored.groupBy(cluster).agg(F.min_by(key, F.struct(-F.round("score", 9), key)).alias(key), F.max("score").alias("score"))

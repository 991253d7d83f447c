"""Related items: several signals for one item, merged by target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_proxy(n: Column, full: float = 30.0) -> Column:
    """A count as a similarity: min(1, ln(n + 1) / ln(full))."""
    return F.least(F.lit(1.0), F.log(n + 1) / F.log(F.lit(full)))


def linear_proxy(n: Column) -> Column:
    """A count of shared authors as a similarity: min(1, 0.5 + 0.15 n)."""
    return F.least(F.lit(1.0), 0.5 + 0.15 * n)


def merged(signals: list[DataFrame], bonus: float = 0.15) -> DataFrame:
    """Signals (target, signal, similarity, n) become one row a target: the best similarity, the names of its signals, and
    a score with a bonus for every signal."""
    union = reduce(DataFrame.unionByName, signals)
    one = union.groupBy("target").agg(F.max("similarity").alias("similarity"), F.sort_array(F.collect_set("signal")).alias("_s"), F.max("n").alias("n"))
    score = F.round(F.col("similarity") + bonus * F.size("_s"), 6)
    return one.select("target", F.round("similarity", 6).alias("similarity"), F.array_join("_s", "+").alias("signals"), "n", score.alias("score"))


def related_items(items: DataFrame, mentions: DataFrame, authors: DataFrame, refs: DataFrame, item: int, limit: int = 15) -> DataFrame:
    """The items most related to one: by shared entities (two or more), shared authors, and citations either way."""
    own = mentions.filter(F.col("item_id") == item).select("entity_type", "entity_id").distinct()
    shared = mentions.filter(F.col("item_id") != item).join(F.broadcast(own), ["entity_type", "entity_id"], "left_semi").groupBy(F.col("item_id").alias("target"))
    shared = shared.agg(F.count_distinct("entity_type", "entity_id").alias("n")).filter("n >= 2").withColumns({"signal": F.lit("entities"), "similarity": log_proxy(F.col("n"))})
    writers = authors.filter(F.col("item_id") == item).select("author_id")
    wrote = authors.filter(F.col("item_id") != item).join(F.broadcast(writers), "author_id", "left_semi").groupBy(F.col("item_id").alias("target"))
    wrote = wrote.agg(F.count("*").alias("n")).withColumns({"signal": F.lit("authors"), "similarity": linear_proxy(F.col("n"))})
    cites = refs.filter((F.col("source_item") == item) & F.col("target_item").isNotNull()).select(F.col("target_item").alias("target"))
    cites = cites.unionByName(refs.filter(F.col("target_item") == item).select(F.col("source_item").alias("target"))).distinct()
    cites = cites.select("target", F.lit(1).cast("long").alias("n"), F.lit("citation").alias("signal"), F.lit(0.9).alias("similarity"))
    found = merged([shared, wrote, cites]).join(items.select(F.col("item_id").alias("target"), "collection"), "target")
    return found.orderBy(F.desc("score"), "target").limit(limit)


RELATED_SQL = """WITH own AS (SELECT DISTINCT entity_type, entity_id FROM entity_mentions WHERE item_id = 1),
    s AS (SELECT item_id AS target, count(DISTINCT (entity_type, entity_id)) AS n, 'entities' AS signal FROM entity_mentions SEMI JOIN own USING (entity_type, entity_id)
      WHERE item_id <> 1 GROUP BY 1 HAVING count(DISTINCT (entity_type, entity_id)) >= 2),
    w AS (SELECT item_id AS target, count(*) AS n, 'authors' AS signal FROM authors_rels WHERE item_id <> 1 AND author_id IN (SELECT author_id FROM authors_rels WHERE item_id = 1) GROUP BY 1),
    c AS (SELECT target_item AS target, 1 AS n, 'citation' AS signal FROM references_cited WHERE source_item = 1 AND target_item IS NOT NULL UNION
      SELECT source_item, 1, 'citation' FROM references_cited WHERE target_item = 1),
    u AS (SELECT target, n, signal, least(1.0, ln(n + 1) / ln(30.0)) AS similarity FROM s UNION ALL SELECT target, n, signal, least(1.0, 0.5 + 0.15 * n) FROM w
      UNION ALL SELECT target, n, signal, 0.9 FROM c),
    g AS (SELECT target, max(similarity) AS sim, string_agg(DISTINCT signal, '+' ORDER BY signal) AS signals, max(n) AS n, count(DISTINCT signal) AS k FROM u GROUP BY 1)
    SELECT target, round(sim, 6) AS similarity, signals, CAST(g.n AS BIGINT) AS n, round(sim + 0.15 * k, 6) AS score, collection FROM g JOIN items ON item_id = target ORDER BY score DESC, target LIMIT 15"""


def composite(signals: list[DataFrame], key: str, least: float) -> DataFrame:
    """Signals (key, score) summed by key; rows under ``least`` go."""
    return reduce(DataFrame.unionByName, signals).groupBy(key).agg(F.sum("score").alias("score")).filter(F.col("score") >= least)


def eligible(counts: DataFrame, size: int = 30) -> DataFrame:
    """Groups (size, p publications, d documents, s species, k concepts) with enough content, their score 3 p + 2 d + s + k / 2 and
    their kind by the share of publications."""
    score = F.col("p") * 3 + F.col("d") * 2 + F.col("s") + F.col("k") * 0.5
    ratio = F.col("p") / (F.col("p") + F.col("d") + 1)
    kind = F.when(ratio > 0.7, "research").when(ratio < 0.3, "policy").otherwise("mixed")
    enough = (F.col("p") >= 3) | (F.col("d") >= 3) | ((F.col("s") >= 10) & (F.col("k") >= 5))
    return counts.withColumns({"score": score, "kind": kind}).filter((F.col("size") >= size) & enough & (F.col("score") >= 15))

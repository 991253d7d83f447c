"""The knowledge-collection relations, as views over the driver's tables.

items are orders, entities are parts and suppliers mentioned by the items, authors are suppliers, citations follow each
customer's previous order, topics form a tree over customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAPPED = {"publication": ("orders", "o_orderkey"), "author": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "topic": ("customer", "c_custkey"), "document": ("documents", "doc_id")}
DEALT = 500_000  # rows of a task


class Tables:
    """Reads tables of one folder; every method is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A table of many rows, dealt by a key into parts of at most DEALT rows: what a task sorts and makes distinct does not grow
        with the table where the number of partitions is given.  Spark deals the other side of a join alike."""
        parts, usual = df.count() // DEALT + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(parts, key) if parts > usual else df

    def items(self) -> DataFrame:
        return self("orders").select(
            F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("collection"),
            F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"),
            F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cites"),
            F.col("o_orderpriority").alias("subtype"), F.col("o_custkey").alias("owner_id"),
        )

    def entity_mentions(self) -> DataFrame:
        line = self("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        orders = self("orders").select("o_orderkey", "o_orderstatus")
        kinds = F.array(
            F.struct(F.lit("part").alias("entity_type"), F.col("l_partkey").alias("entity_id")),
            F.struct(F.lit("supplier").alias("entity_type"), F.col("l_suppkey").alias("entity_id")),
        )
        joined = self._dealt(line, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.inline(kinds), F.col("o_orderstatus").alias("collection"), F.col("o_orderkey").alias("item_id"), F.col("l_returnflag").alias("role"))

    def entity_names(self) -> DataFrame:
        names = self("part").select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
        names = names.unionByName(self("supplier").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")))
        degree = self.entity_mentions().groupBy("entity_type", "entity_id").agg(F.count_distinct("item_id").alias("degree"))
        return names.join(degree, ["entity_type", "entity_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def authors_rels(self) -> DataFrame:
        pairs = self("lineitem").select(F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("item_id")).distinct()
        rels = pairs.join(self("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("collection")), "item_id")
        return rels.select("author_id", "collection", "item_id", F.row_number().over(W.partitionBy("item_id").orderBy("author_id")).alias("ord"))

    def references_cited(self) -> DataFrame:
        before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        refs = self("orders").select(F.col("o_orderkey").alias("source_item"), before.alias("target_item"))
        return refs.withColumn("link_type", F.when(F.col("target_item").isNull(), "external").otherwise("internal"))

    def topics(self) -> DataFrame:
        return self("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 4).cast("long")).alias("parent_id"))

    def lookup(self, kind: str, ids: list[int]) -> DataFrame:
        """Rows of a mapped table by id; an unknown kind is an error."""
        if kind not in MAPPED:
            raise ValueError(f"unknown entity type: {kind}")
        name, key = MAPPED[kind]
        return self(name).filter(F.col(key).isin(ids))

    def jsonb_columns(self, name: str) -> list[str]:
        """Columns that hold nested values."""
        return [f.name for f in self(name).schema if f.dataType.typeName() in ("map", "struct", "array", "variant")]


VIEWS = {
    "items": """SELECT o_orderkey AS item_id, o_orderstatus AS collection, o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title,
        CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cites, o_orderpriority AS subtype,
        o_custkey AS owner_id FROM orders""",
    "entity_mentions": """SELECT 'part' AS entity_type, l_partkey AS entity_id, o_orderstatus AS collection, o_orderkey AS item_id, l_returnflag AS role
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
        SELECT 'supplier', l_suppkey, o_orderstatus, o_orderkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "entity_names": """SELECT n.*, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM (SELECT 'part' AS entity_type, p_partkey AS entity_id, p_name AS name FROM part
        UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) n LEFT JOIN (SELECT entity_type, entity_id, count(DISTINCT item_id) AS degree
        FROM entity_mentions GROUP BY 1, 2) d USING (entity_type, entity_id)""",
    "authors_rels": """SELECT author_id, o_orderstatus AS collection, item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY author_id) AS INTEGER) AS ord
        FROM (SELECT DISTINCT l_suppkey AS author_id, l_orderkey AS item_id FROM lineitem) p JOIN orders ON item_id = o_orderkey""",
    "references_cited": """SELECT *, CASE WHEN target_item IS NULL THEN 'external' ELSE 'internal' END AS link_type FROM (SELECT o_orderkey AS source_item,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target_item FROM orders) r""",
    "topics": """SELECT c_custkey AS id, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent_id FROM customer""",
}
NEEDS = {"entity_names": ("entity_mentions",)}


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it mentions in front."""
    used = {v for v in VIEWS if v in sql}
    used |= {n for v in used for n in NEEDS.get(v, ())}
    head = ",\n".join(f"{v} AS ({q})" for v, q in VIEWS.items() if v in used)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"

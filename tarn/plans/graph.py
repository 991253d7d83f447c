"""Queries: joins over mentions, authors and citations, graph building, related works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import browse, communities, graph, related
from tarn.operators.storage import stored
from tarn.plans.registry import query
from tarn.sources.tables import Tables

PAIRS = """SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS weight FROM (SELECT DISTINCT entity_id, item_id FROM entity_mentions WHERE entity_type = 'part') a
    JOIN (SELECT DISTINCT entity_id, item_id FROM entity_mentions WHERE entity_type = 'part') b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2"""


def part_pairs(t: Tables, at_least: int = 2) -> DataFrame:
    return graph.pair_counts(t.entity_mentions().filter("entity_type = 'part'"), ["item_id"], "entity_id", at_least)


CO = """SELECT m.entity_type, m.entity_id, n.name, count(DISTINCT m.item_id) AS shared FROM entity_mentions m JOIN entity_names n USING (entity_type, entity_id)
    WHERE m.entity_type = 'part' AND m.item_id IN (SELECT item_id FROM entity_mentions WHERE entity_type = 'supplier' AND entity_id = 7)
    GROUP BY 1, 2, 3 ORDER BY shared DESC, entity_id LIMIT 30"""


@query("joi04_co_occurring", CO)
def co_occurring(t: Tables) -> DataFrame:
    names = t.entity_names().select("entity_type", "entity_id", "name")
    top = browse.page(graph.co_occurring(t.entity_mentions(), "supplier", 7, "part"), [F.desc("shared"), F.col("entity_id")], 30)
    return top.join(names, ["entity_type", "entity_id"]).select("entity_type", "entity_id", "name", "shared")


@query("joi01_fact_dim", "SELECT collection, n.name, count(*) AS n FROM entity_mentions m JOIN entity_names n USING (entity_type, entity_id) WHERE entity_type = 'supplier' GROUP BY 1, 2")
def joi01(t: Tables) -> DataFrame:
    joined = t.entity_mentions().filter("entity_type = 'supplier'").join(t.entity_names(), ["entity_type", "entity_id"])
    return joined.groupBy("collection", "name").agg(F.count("*").alias("n"))


@query("joi02_ordered_authors", "SELECT item_id, author_id, s_name, ord FROM authors_rels JOIN supplier ON s_suppkey = author_id WHERE collection = 'P'")
def joi02(t: Tables) -> DataFrame:
    return t.authors_rels().filter("collection = 'P'").join(t("supplier"), F.col("author_id") == F.col("s_suppkey")).select("item_id", "author_id", "s_name", "ord")


@query("joi03_left_targets", """SELECT r.source_item, r.link_type, i.title AS target_title FROM references_cited r LEFT JOIN items i ON i.item_id = r.target_item""")
def joi03(t: Tables) -> DataFrame:
    targets = t.items().select(F.col("item_id").alias("target_item"), F.col("title").alias("target_title"))
    return t.references_cited().join(targets, "target_item", "left").select("source_item", "link_type", "target_title")


@query("joi06_pairs", f"SELECT * FROM ({PAIRS}) p WHERE weight >= 2")
def joi06(t: Tables) -> DataFrame:
    return part_pairs(t)


@query("joi08_coauthors", """SELECT a.author_id AS a, b.author_id AS b, count(*) AS weight FROM authors_rels a JOIN authors_rels b USING (item_id) WHERE a.author_id < b.author_id GROUP BY 1, 2""")
def joi08(t: Tables) -> DataFrame:
    return graph.pair_counts(t.authors_rels(), ["collection", "item_id"], "author_id")


@query("joi09_author_network", """SELECT b.author_id, count(*) AS shared FROM authors_rels a JOIN authors_rels b USING (item_id) WHERE a.author_id = 3 AND b.author_id <> 3
    GROUP BY 1 ORDER BY shared DESC, 1 LIMIT 8""")
def joi09(t: Tables) -> DataFrame:
    rels = t.authors_rels()
    own = rels.filter("author_id = 3").select("item_id")
    shared = rels.filter("author_id <> 3").join(own, "item_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("shared"))
    return browse.page(shared, [F.desc("shared"), F.col("author_id")], 8)


@query("joi12_without_mentions", "SELECT item_id, title FROM items WHERE item_id NOT IN (SELECT item_id FROM entity_mentions)")
def joi12(t: Tables) -> DataFrame:
    return t.items().join(t("lineitem").select(F.col("l_orderkey").alias("item_id")), "item_id", "left_anti").select("item_id", "title")


@query("joi13_with_mentions", "SELECT collection, count(*) AS n FROM items WHERE EXISTS (SELECT 1 FROM entity_mentions m WHERE m.item_id = items.item_id) GROUP BY 1")
def joi13(t: Tables) -> DataFrame:
    return t.items().join(t("lineitem").select(F.col("l_orderkey").alias("item_id")), "item_id", "left_semi").groupBy("collection").agg(F.count("*").alias("n"))


@query("joi14_cited_by_count", "SELECT item_id, (SELECT count(*) FROM references_cited r WHERE r.target_item = i.item_id) AS cited_by FROM items i")
def joi14(t: Tables) -> DataFrame:
    counts = t.references_cited().groupBy(F.col("target_item").alias("item_id")).agg(F.count("*").alias("n"))
    return t.items().join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("cited_by"))


@query("joi19_function_join", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON regexp_replace(lower(a.p_name), 's$', '') = regexp_replace(lower(b.p_name), 's$', '')
    AND a.p_partkey < b.p_partkey AND a.p_size = b.p_size""")
def joi19(t: Tables) -> DataFrame:
    keyed = t("part").select("p_partkey", "p_size", F.regexp_replace(F.lower("p_name"), "s$", "").alias("k"))
    return graph.equal_pairs(keyed, ["k", "p_size"], "p_partkey")


@query("joi21_near_years", """SELECT a.item_id AS a, b.item_id AS b FROM items a JOIN items b ON a.owner_id = b.owner_id AND a.subtype = b.subtype AND a.item_id < b.item_id
    AND (a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 1)""")
def joi21(t: Tables) -> DataFrame:
    own = t.items().select("item_id", "owner_id", "subtype", "year")
    a, b = own.withColumnsRenamed({"item_id": "a", "year": "ya"}), own.withColumnsRenamed({"item_id": "b", "year": "yb"})
    near = F.coalesce(F.abs(F.col("ya") - F.col("yb")) <= 1, F.lit(True))
    return a.join(b, ["owner_id", "subtype"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")


@query("joi23_hierarchy", "SELECT p.id, count(c.id) AS children FROM topics p LEFT JOIN topics c ON c.parent_id = p.id GROUP BY 1")
def joi23(t: Tables) -> DataFrame:
    kids = t.topics().filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return t.topics().join(kids, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("children"))


@query("gra04_first_edge_wins", f"""WITH e AS (SELECT a, b, weight, 1 AS phase FROM ({PAIRS}) p WHERE weight >= 2 UNION ALL
    SELECT b, a, 9, 2 FROM ({PAIRS}) p WHERE weight >= 1 AND (a + b) % 7 = 0)
    SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(weight AS BIGINT) AS weight, phase FROM e
    QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY phase, weight) = 1""")
def gra04(t: Tables) -> DataFrame:
    pairs = stored(part_pairs(t, 1).filter("weight >= 2 or (a + b) % 7 = 0"), "pairs")
    first = pairs.filter("weight >= 2").withColumn("phase", F.lit(1))
    second = pairs.filter("(a + b) % 7 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(9).cast("long").alias("weight"), F.lit(2).alias("phase"))
    edges = graph.undirected(first.unionByName(second), [F.col("phase"), F.col("weight")], rows=2 * pairs.count())
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "phase")


@query("gra06_unified_edges", f"""WITH co AS (SELECT 'co_occurrence' AS family, 'part:' || a AS source, 'part:' || b AS target, CAST(least(weight, 5) AS DOUBLE) AS weight FROM ({PAIRS}) p WHERE weight >= 2),
    author AS (SELECT 'author_item', 'author:' || author_id, 'item:' || item_id, 3.0 FROM authors_rels),
    cites AS (SELECT 'citation', 'item:' || source_item, 'item:' || target_item, 6.0 FROM references_cited WHERE link_type = 'internal'),
    co_author AS (SELECT 'co_author', 'author:' || a.author_id, 'author:' || b.author_id, CAST(5 * count(*) AS DOUBLE) FROM authors_rels a JOIN authors_rels b USING (item_id) WHERE a.author_id < b.author_id GROUP BY a.author_id, b.author_id)
    SELECT * FROM co UNION ALL SELECT * FROM author UNION ALL SELECT * FROM cites UNION ALL SELECT * FROM co_author""")
def gra06(t: Tables) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, family, s, d, w: df.select(F.lit(family).alias("family"), s.alias("source"), d.alias("target"), w.cast("double").alias("weight"))
    co = edge(part_pairs(t), "co_occurrence", name("part", "a"), name("part", "b"), F.least(F.col("weight"), F.lit(5)))
    author = edge(t.authors_rels(), "author_item", name("author", "author_id"), name("item", "item_id"), F.lit(3))
    cites = edge(t.references_cited().filter("link_type = 'internal'"), "citation", name("item", "source_item"), name("item", "target_item"), F.lit(6))
    pairs = graph.pair_counts(t.authors_rels(), ["item_id"], "author_id")
    return co.unionByName(author).unionByName(cites).unionByName(edge(pairs, "co_author", name("author", "a"), name("author", "b"), F.col("weight") * 5))


def _peeled(rounds: int) -> str:
    """Unrolled in SQL: as many rounds as the data need at any of the test scales."""
    sql = f"WITH e0 AS (SELECT a, b, weight FROM ({PAIRS}) p WHERE weight >= 2)"
    for k in range(rounds):
        sql += f", n{k} AS (SELECT node FROM (SELECT a AS node FROM e{k} UNION ALL SELECT b FROM e{k}) x GROUP BY 1 HAVING count(*) >= 4), e{k + 1} AS (SELECT * FROM e{k} WHERE a IN (SELECT node FROM n{k}) AND b IN (SELECT node FROM n{k}))"
    return f"{sql} SELECT a, b, weight FROM e{rounds}"


@query("gra07_peel", _peeled(12))
def gra07(t: Tables) -> DataFrame:
    return graph.peel(part_pairs(t), 4)


@query("gra08_node_sizes", f"""WITH e AS (SELECT * FROM ({PAIRS}) p WHERE weight >= 2)
    SELECT node, count(*) AS degree, round(2.0 + ln(count(*) + 1) * 3.0, 6) AS size FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) x GROUP BY 1""")
def gra08(t: Tables) -> DataFrame:
    return graph.degrees(part_pairs(t)).withColumn("size", F.round(graph.node_size(F.col("degree")), 6))


@query("gra09_communities")
def gra09(t: Tables) -> DataFrame:
    return communities.louvain(part_pairs(t))


BRANDS = "SELECT p_partkey AS node, p_brand AS community FROM part"


@query("gra09_modularity", f"""WITH e AS (SELECT * FROM ({PAIRS}) p WHERE weight >= 2), l AS ({BRANDS}), n AS (SELECT e.*, x.community AS ca, y.community AS cb FROM e JOIN l x ON x.node = a JOIN l y ON y.node = b),
    c AS (SELECT c, sum(weight) AS ends, sum(weight) FILTER (same) AS inside FROM (SELECT ca AS c, weight, ca = cb AS same FROM n UNION ALL SELECT cb, weight, ca = cb FROM n) x GROUP BY 1)
    SELECT r AS resolution, round(sum(coalesce(inside, 0)) / sum(ends) - r * sum(ends * ends) / (sum(ends) * sum(ends)), 9) AS modularity, count(*) AS communities FROM c, (SELECT unnest([1.0::DOUBLE, 3.0, 6.0]) AS r) r GROUP BY r""")
def gra09_modularity(t: Tables) -> DataFrame:
    """Of a given labelling, at the resolutions that graphs of this kind are cut with."""
    pairs, labels = part_pairs(t), t("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    rows = [communities.modularity(pairs, labels, r).select(F.lit(r).alias("resolution"), F.round("modularity", 9).alias("modularity"), "communities") for r in (1.0, 3.0, 6.0)]
    return reduce(DataFrame.unionByName, rows)


def part_names(t: Tables, pairs: DataFrame) -> DataFrame:
    return graph.degrees(pairs).join(t("part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("type"), F.col("p_name").alias("name")), "node")


@query("gra10_community_summary")
def gra10(t: Tables) -> DataFrame:
    pairs = stored(part_pairs(t), "pairs")
    return graph.community_summary(communities.louvain(pairs), part_names(t, pairs)).withColumn("type_counts", F.to_json("type_counts"))


@query("gra10_summary_of_brands", f"""WITH e AS (SELECT * FROM ({PAIRS}) p WHERE weight >= 2), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) x GROUP BY 1),
    m AS (SELECT p_brand AS community, p_partkey AS node, p_type AS type, p_name AS name, degree FROM d JOIN part ON node = p_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rn, row_number() OVER (PARTITION BY community, type ORDER BY degree DESC, node) AS rt FROM m),
    k AS (SELECT community, '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' AS type_counts FROM (SELECT community, type, count(*) AS n FROM m GROUP BY 1, 2) x GROUP BY 1)
    SELECT r.community, count(*) AS members, min(type_counts) AS type_counts, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 8) AS label, string_agg(name, ', ' ORDER BY type, rt) FILTER (rt <= 3) AS diverse
    FROM r JOIN k USING (community) GROUP BY 1 HAVING count(*) >= 3""")
def gra10_brands(t: Tables) -> DataFrame:
    """The summary of a given labelling."""
    pairs = stored(part_pairs(t), "pairs")
    labels = t("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return graph.community_summary(labels, part_names(t, pairs)).withColumn("type_counts", F.to_json("type_counts"))


@query("rel01_related_works", related.RELATED_SQL)
def rel01(t: Tables) -> DataFrame:
    return related.related_items(t.items(), t.entity_mentions(), t.authors_rels(), t.references_cited(), 1)


@query("rel05_overlap_without_citation", f"""WITH s AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM (SELECT DISTINCT entity_type, entity_id, item_id FROM entity_mentions WHERE entity_type = 'part') a
    JOIN (SELECT DISTINCT entity_type, entity_id, item_id FROM entity_mentions WHERE entity_type = 'part') b USING (entity_type, entity_id) WHERE a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, shared FROM s WHERE NOT EXISTS (SELECT 1 FROM references_cited r WHERE (r.source_item = a AND r.target_item = b) OR (r.source_item = b AND r.target_item = a))""")
def rel05(t: Tables) -> DataFrame:
    shared = graph.pair_counts(t.entity_mentions().filter("entity_type = 'part'"), ["entity_id"], "item_id", 2).withColumnRenamed("weight", "shared")
    cited = t.references_cited().filter("target_item is not null").select(F.least("source_item", "target_item").alias("a"), F.greatest("source_item", "target_item").alias("b"))
    return shared.join(cited, ["a", "b"], "left_anti")


@query("rel07_citations", """SELECT CASE WHEN target_item IS NULL THEN 'external' ELSE 'cites' END AS direction, target_item AS other FROM references_cited WHERE source_item = 100
    UNION ALL SELECT 'cited_by', source_item FROM references_cited WHERE target_item = 100""")
def rel07(t: Tables) -> DataFrame:
    return graph.citations(t.references_cited(), 100)


@query("gra01_ego_network", f"""WITH near AS ({CO}), pairs AS (SELECT a.entity_id AS a, b.entity_id AS b, count(DISTINCT a.item_id) AS weight FROM entity_mentions a JOIN entity_mentions b
      ON a.item_id = b.item_id AND a.entity_id < b.entity_id WHERE a.entity_type = 'part' AND b.entity_type = 'part'
      AND a.entity_id IN (SELECT entity_id FROM near) AND b.entity_id IN (SELECT entity_id FROM near) GROUP BY 1, 2 HAVING count(DISTINCT a.item_id) >= 1 ORDER BY weight DESC, a, b LIMIT 50)
    SELECT 'supplier:7' AS source, 'part:' || entity_id AS target, shared AS weight FROM near UNION ALL SELECT 'part:' || a, 'part:' || b, weight FROM pairs""")
def gra01(t: Tables) -> DataFrame:
    near = co_occurring(t).select("entity_id", "shared")
    inner = t.entity_mentions().filter("entity_type = 'part'").join(F.broadcast(near.select("entity_id")), "entity_id", "left_semi")
    pairs = browse.page(graph.pair_counts(inner, ["item_id"], "entity_id"), [F.desc("weight"), F.col("a"), F.col("b")], 50)
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    return near.select(F.lit("supplier:7").alias("source"), part("entity_id").alias("target"), F.col("shared").alias("weight")).unionByName(pairs.select(part("a").alias("source"), part("b").alias("target"), "weight"))


@query("agg16_weighted_degree", f"""WITH e AS (SELECT * FROM ({PAIRS}) p WHERE weight >= 2) SELECT node, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) x GROUP BY 1""")
def agg16(t: Tables) -> DataFrame:
    return part_pairs(t).select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("strength"))


@query("mth03_rescale", """WITH d AS (SELECT owner_id, CAST(count(*) AS DOUBLE) AS v FROM items GROUP BY 1) SELECT owner_id, round((v - (SELECT min(v) FROM d)) / ((SELECT max(v) FROM d) - (SELECT min(v) FROM d)) * 1000 - 500, 6) AS x FROM d""")
def mth03(t: Tables) -> DataFrame:
    d = t.items().groupBy("owner_id").agg(F.count("*").cast("double").alias("v"))
    low, high = d.agg(F.min("v"), F.max("v")).first()
    return d.select("owner_id", F.round((F.col("v") - low) / (high - low) * 1000 - 500, 6).alias("x"))


@query("win05_strongest_link", """SELECT source_item, target_item, kind FROM (SELECT source_item, target_item, 'citation' AS kind, 1 AS p FROM references_cited WHERE target_item IS NOT NULL
    UNION ALL SELECT item_id, before, 'author', 2 FROM (SELECT item_id, lag(item_id) OVER (PARTITION BY author_id ORDER BY item_id) AS before FROM authors_rels) r WHERE before IS NOT NULL) x
    QUALIFY row_number() OVER (PARTITION BY source_item, target_item ORDER BY p) = 1""")
def win05(t: Tables) -> DataFrame:
    """Links of every author: each item to the author's one before, so rows stay linear in authors_rels."""
    cites = t.references_cited().filter("target_item is not null").select("source_item", "target_item", F.lit("citation").alias("kind"), F.lit(1).alias("p"))
    before = F.lag("item_id").over(W.partitionBy("author_id").orderBy("item_id"))
    following = t.authors_rels().select(F.col("item_id").alias("source_item"), before.alias("target_item")).filter("target_item is not null")
    links = cites.unionByName(following.select("source_item", "target_item", F.lit("author").alias("kind"), F.lit(2).alias("p")))
    return browse.first_per_group(links, ["source_item", "target_item"], [F.col("p")]).drop("p")


@query("win09_top_per_type", """SELECT entity_type, entity_id, degree, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY degree DESC, entity_id) AS INTEGER) AS rn FROM entity_names) x WHERE rn <= 3""")
def win09(t: Tables) -> DataFrame:
    return browse.top_per_group(t.entity_names(), ["entity_type"], [F.desc("degree"), F.col("entity_id")], 3).select("entity_type", "entity_id", "degree", "rn")

"""Queries: further joins over mentions and authors, ego networks, subgraphs, vector neighbours, composite relations, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import browse, graph, related, sync, vectors
from tarn.operators.storage import stored
from tarn.plans.graph import PAIRS, part_pairs
from tarn.plans.registry import query
from tarn.plans.text import COSINE, VECTORS
from tarn.sources.tables import Tables


def name(kind: str, c: str):
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


@query("joi05_pairs_once", """SELECT a.entity_type || ':' || a.entity_id AS a, b.entity_type || ':' || b.entity_id AS b, count(*) AS n FROM (SELECT DISTINCT entity_type, entity_id, item_id FROM entity_mentions) a
    JOIN (SELECT DISTINCT entity_type, entity_id, item_id FROM entity_mentions) b ON a.item_id = b.item_id AND (a.entity_type || ':' || a.entity_id) < (b.entity_type || ':' || b.entity_id) GROUP BY 1, 2 HAVING count(*) >= 3""")
def joi05(t: Tables) -> DataFrame:
    """Entities of any type; each pair once, in the order of type and id."""
    members = t.entity_mentions().select("item_id", F.concat_ws(":", "entity_type", F.col("entity_id").cast("string")).alias("e"))
    return graph.pair_counts(members, ["item_id"], "e", 3).withColumnRenamed("weight", "n")


@query("joi07_shared_by_two_steps", """WITH r AS (SELECT DISTINCT l_suppkey AS p, l_orderkey AS i FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS i, l_partkey % 50 AS sp FROM lineitem), ps AS (SELECT DISTINCT p, sp FROM r JOIN s USING (i))
    SELECT a.p AS a, b.p AS b, count(*) AS shared FROM ps a JOIN ps b ON a.sp = b.sp AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2""")
def joi07(t: Tables) -> DataFrame:
    """What two protocols share by way of their items; the items of the two sides are not joined."""
    rels = t("lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_orderkey").alias("i")).distinct()
    species = t("lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") % 50).alias("sp")).distinct()
    return graph.pair_counts_by_class(rels.join(species, "i").select("p", "sp"), ["sp"], "p", 2).withColumnRenamed("weight", "shared")


@query("joi10_shared_authors", """SELECT a.item_id AS a, b.item_id AS b, count(*) AS weight FROM authors_rels a JOIN authors_rels b ON a.author_id = b.author_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def joi10(t: Tables) -> DataFrame:
    return graph.pair_counts(t.authors_rels(), ["author_id"], "item_id", 3)


@query("joi11_shared_across", """WITH d AS (SELECT DISTINCT entity_type, entity_id, collection, item_id FROM entity_mentions)
    SELECT a.item_id AS publication, b.item_id AS dataset, count(*) AS shared FROM d a JOIN d b USING (entity_type, entity_id) WHERE a.collection = 'F' AND b.collection = 'P' GROUP BY 1, 2 HAVING count(*) >= 2""")
def joi11(t: Tables) -> DataFrame:
    """Entities of all types that an item of one collection shares with one of another."""
    of = lambda c: t.entity_mentions().filter(F.col("collection") == c)
    shared = graph.shared_counts(of("F"), of("P"), ["entity_type", "entity_id"], "item_id", 2)
    return shared.withColumnsRenamed({"a": "publication", "b": "dataset", "weight": "shared"})


@query("joi15_lateral_aggregates", """SELECT c_custkey, coalesce(o.n, 0) AS orders, o.last, coalesce(r.n, 0) AS cited FROM customer
    LEFT JOIN LATERAL (SELECT count(*) AS n, max(o_orderdate) AS last FROM orders WHERE o_custkey = c_custkey) o ON true
    LEFT JOIN LATERAL (SELECT count(*) AS n FROM references_cited JOIN items ON item_id = target_item WHERE owner_id = c_custkey) r ON true""")
def joi15(t: Tables) -> DataFrame:
    """Each lateral is one aggregation by key, joined to the left."""
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last"))
    cited = t.references_cited().join(t.items().select(F.col("item_id").alias("target_item"), F.col("owner_id").alias("c_custkey")), "target_item").groupBy("c_custkey").agg(F.count("*").alias("cited"))
    joined = t("customer").select("c_custkey").join(orders, "c_custkey", "left").join(cited, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "last", F.coalesce("cited", F.lit(0)).alias("cited"))


@query("joi16_cross_collection_neighbours", f"""WITH {VECTORS}, s AS (SELECT a.vec_id AS query, b.label AS label, b.vec_id, {COSINE} AS sim FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query, label, vec_id, round(sim, 6) AS similarity FROM s WHERE sim > 0.1 QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY round(sim, 9) DESC, vec_id) <= 3""")
def joi16(t: Tables) -> DataFrame:
    """Of every collection (label) the nearest of each query vector; the queries are every 50th row, against all rows."""
    v = t("embeddings")
    asked = v.filter("vec_id % 50 = 0")
    found = None
    for (label,) in v.select("label").distinct().orderBy("label").collect():
        one = vectors.nearest_each(asked, v.filter(F.col("label").eqNullSafe(label)), 3, 0.1).select("query", F.lit(label).alias("label"), "vec_id", F.round("similarity", 6).alias("similarity"))
        found = one if found is None else found.unionByName(one)
    return found


@query("joi18_vector_distance", f"WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, CAST(round({COSINE} * 5) AS BIGINT) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id AND 1 - {COSINE} < 0.62")
def joi18(t: Tables) -> DataFrame:
    """VEC-03's edges: pairs within a distance, with a weight of five times the similarity."""
    return vectors.similar_pairs(t("embeddings"), 0.38).filter("1 - similarity < 0.62").select("a", "b", F.round(F.col("similarity") * 5).cast("long").alias("weight"))


@query("joi24_author_topics", "SELECT author_id, c_mktsegment AS topic, count(DISTINCT r.item_id) AS works FROM authors_rels r JOIN items i ON i.item_id = r.item_id JOIN customer ON c_custkey = owner_id GROUP BY 1, 2")
def joi24(t: Tables) -> DataFrame:
    """Author to work to topic."""
    works = t.authors_rels().select("author_id", "item_id").join(t.items().select("item_id", F.col("owner_id").alias("c_custkey")), "item_id")
    return works.join(t("customer").select("c_custkey", F.col("c_mktsegment").alias("topic")), "c_custkey").groupBy("author_id", "topic").agg(F.count_distinct("item_id").alias("works"))


@query("joi25_positions_in_arrays", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE list_contains([1, 3, CAST(o_orderkey % 5 AS INTEGER)], l_linenumber)")
def joi25(t: Tables) -> DataFrame:
    """Steps of an item at the places that an array of it names; the array is flattened and joined by place."""
    places = F.from_json(F.expr("concat('[1,3,', o_orderkey % 5, ']')"), "array<int>")
    wanted = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array_distinct(places)).alias("l_linenumber"))
    return t("lineitem").join(wanted, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("vec06_canonical_members", f"""WITH {VECTORS}, p AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), b AS (SELECT label, list(m ORDER BY i) AS e FROM m GROUP BY 1),
    s AS (SELECT a.label, a.vec_id, {COSINE} AS c, a.vec_id % 17 AS d1, a.vec_id % 5 AS d2, CASE WHEN a.vec_id % 4 > 0 THEN 2000 + a.vec_id % 9 END AS y FROM v a JOIN b USING (label)),
    w AS (SELECT *, (0.6 * d1 / greatest(max(d1) OVER g, 1) + 0.4 * d2 / greatest(max(d2) OVER g, 1)) AS detail, (coalesce(y, 2000) - min(coalesce(y, 2000)) OVER g) / CASE WHEN max(coalesce(y, 2000)) OVER g = min(coalesce(y, 2000)) OVER g THEN 1 ELSE max(coalesce(y, 2000)) OVER g - min(coalesce(y, 2000)) OVER g END AS recent FROM s WINDOW g AS (PARTITION BY label))
    SELECT label, vec_id, round(0.35 * c + 0.35 * detail + 0.3 * recent, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(0.35 * c + 0.35 * detail + 0.3 * recent, 9) DESC, vec_id) = 1""")
def vec06(t: Tables) -> DataFrame:
    v = t("embeddings")
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    k = F.col("vec_id")
    members = v.join(mean, "label").select("label", "vec_id", vectors.cosine(F.col("embedding"), F.col("c")).alias("sim"), (k % 17).alias("d1"), (k % 5).alias("d2"), F.when(k % 4 > 0, 2000 + k % 9).alias("y"))
    return vectors.canonical(members, "label", "vec_id", "sim", {"d1": 0.6, "d2": 0.4}, "y").withColumn("score", F.round("score", 6))


@query("vec08_threshold_sweep")
def vec08(t: Tables) -> DataFrame:
    return vectors.cluster_sweep(t("embeddings"), [0.2, 0.3, 0.4], "label")


@query("vec09_neighbours_of_singles", f"""WITH {VECTORS}, near AS (SELECT a.vec_id, max({COSINE}) AS top FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1), lone AS (SELECT vec_id FROM near WHERE top < 0.33)
    SELECT a.vec_id AS query, b.vec_id, round({COSINE}, 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT vec_id FROM lone) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) = 1""")
def vec09(t: Tables) -> DataFrame:
    """Rows without a neighbour at the threshold, and the nearest row of each all the same."""
    v = t("embeddings")
    pairs = vectors.similar_pairs(v, 0.33).select(F.explode(F.array("a", "b")).alias("vec_id")).distinct()
    lone = v.join(pairs, "vec_id", "left_anti")
    return vectors.nearest_each(lone, v, 1, -1.0).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


EGO_PARTS = "(SELECT DISTINCT entity_id, item_id FROM entity_mentions WHERE entity_type = 'part')"


@query("gra02_ego_of_item", f"""WITH e AS (SELECT p.entity_id AS id, n.degree FROM {EGO_PARTS} p JOIN entity_names n ON n.entity_type = 'part' AND n.entity_id = p.entity_id WHERE p.item_id = 7 ORDER BY degree DESC, id LIMIT 30),
    w AS (SELECT author_id FROM authors_rels WHERE item_id = 7), co AS (SELECT b.author_id AS id, count(*) AS n FROM authors_rels b WHERE b.item_id IN (SELECT item_id FROM authors_rels WHERE author_id IN (SELECT author_id FROM w)) AND b.author_id NOT IN (SELECT author_id FROM w) GROUP BY 1 ORDER BY n DESC, id LIMIT 8),
    p AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM {EGO_PARTS} a JOIN {EGO_PARTS} b ON a.item_id = b.item_id AND a.entity_id < b.entity_id WHERE a.entity_id IN (SELECT id FROM e) AND b.entity_id IN (SELECT id FROM e) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 40)
    SELECT 'item:7' AS source, 'part:' || id AS target, degree AS weight FROM e UNION ALL SELECT 'item:7', 'author:' || author_id, 1 FROM w UNION ALL SELECT 'item:7', 'author:' || id, n FROM co
    UNION ALL SELECT 'part:' || a, 'part:' || b, n FROM p UNION ALL SELECT 'item:7', 'item:' || target_item, 1 FROM references_cited WHERE source_item = 7 AND target_item IS NOT NULL UNION ALL SELECT 'item:' || source_item, 'item:7', 1 FROM references_cited WHERE target_item = 7""")
def gra02(t: Tables) -> DataFrame:
    """Its entities by degree, its authors, their most frequent co-authors, citations either way, and edges among the entities."""
    edge = lambda df, s, d, w: df.select(s.alias("source"), d.alias("target"), w.cast("long").alias("weight"))
    me = F.lit("item:7")
    mentions = t.entity_mentions().filter("entity_type = 'part'").select("entity_id", "item_id")
    own = mentions.filter("item_id = 7").select("entity_id").distinct()
    near = browse.page(own.join(t.entity_names().filter("entity_type = 'part'").select("entity_id", "degree"), "entity_id"), [F.desc("degree"), F.col("entity_id")], 30)
    rels = t.authors_rels()
    writers = rels.filter("item_id = 7").select("author_id")
    works = rels.join(F.broadcast(writers), "author_id", "left_semi").select("item_id").distinct()  # an item has few authors
    co = rels.join(works, "item_id", "left_semi").join(F.broadcast(writers), "author_id", "left_anti").groupBy("author_id").agg(F.count("*").alias("n"))
    co = browse.page(co, [F.desc("n"), F.col("author_id")], 8)
    inner = graph.pair_counts(mentions.join(F.broadcast(near.select("entity_id")), "entity_id", "left_semi"), ["item_id"], "entity_id", 2)
    inner = browse.page(inner, [F.desc("weight"), F.col("a"), F.col("b")], 40)
    refs = t.references_cited()
    rows = [
        edge(near, me, name("part", "entity_id"), F.col("degree")), edge(writers, me, name("author", "author_id"), F.lit(1)), edge(co, me, name("author", "author_id"), F.col("n")), edge(inner, name("part", "a"), name("part", "b"), F.col("weight")),
        edge(refs.filter("source_item = 7 and target_item is not null"), me, name("item", "target_item"), F.lit(1)), edge(refs.filter("target_item = 7"), name("item", "source_item"), me, F.lit(1)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("gra03_ego_of_author", """WITH w AS (SELECT i.item_id, i.cites FROM authors_rels r JOIN items i USING (item_id) WHERE author_id = 3 ORDER BY cites DESC, i.item_id LIMIT 10),
    co AS (SELECT b.author_id AS id, count(*) AS n FROM authors_rels a JOIN authors_rels b USING (item_id) WHERE a.author_id = 3 AND b.author_id <> 3 GROUP BY 1 ORDER BY n DESC, id LIMIT 8),
    cc AS (SELECT a.author_id AS a, b.author_id AS b, count(*) AS n FROM authors_rels a JOIN authors_rels b USING (item_id) WHERE a.author_id < b.author_id AND a.author_id IN (SELECT id FROM co) AND b.author_id IN (SELECT id FROM co) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 30)
    SELECT 'author:3' AS source, 'item:' || item_id AS target, cites AS weight FROM w UNION ALL SELECT 'author:3', 'author:' || id, n FROM co UNION ALL SELECT 'author:' || a, 'author:' || b, n FROM cc""")
def gra03(t: Tables) -> DataFrame:
    """The most cited works of an author, the most frequent co-authors, and edges among these."""
    edge = lambda df, s, d, w: df.select(s.alias("source"), d.alias("target"), w.cast("long").alias("weight"))
    rels = t.authors_rels()
    own = rels.filter("author_id = 3").select("item_id")
    works = browse.page(t.items().select("item_id", "cites").join(own, "item_id", "left_semi"), [F.desc("cites"), F.col("item_id")], 10)
    co = browse.page(rels.filter("author_id <> 3").join(own, "item_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("n")), [F.desc("n"), F.col("author_id")], 8)
    inner = graph.pair_counts(rels.join(F.broadcast(co.select("author_id")), "author_id", "left_semi"), ["item_id"], "author_id", 2)
    inner = browse.page(inner, [F.desc("weight"), F.col("a"), F.col("b")], 30)
    me = F.lit("author:3")
    return edge(works, me, name("item", "item_id"), F.col("cites")).unionByName(edge(co, me, name("author", "author_id"), F.col("n"))).unionByName(edge(inner, name("author", "a"), name("author", "b"), F.col("weight")))


@query("gra05_class_weights", f"SELECT a, b, weight * CASE WHEN pa.p_type = pb.p_type THEN 0.5 ELSE 2.0 END::DOUBLE AS weight FROM ({PAIRS}) p JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b WHERE weight >= 2")
def gra05(t: Tables) -> DataFrame:
    kind = lambda n, c: t("part").select(F.col("p_partkey").alias(n), F.col("p_type").alias(c))
    classed = part_pairs(t).join(kind("a", "ca"), "a").join(kind("b", "cb"), "b")
    return graph.class_weighted(classed, "ca", "cb").select("a", "b", "weight")


@query("gra06_more_families", f"""WITH d AS (SELECT DISTINCT entity_type, entity_id, collection, item_id FROM entity_mentions), s AS (SELECT author_id, m.entity_id, least(count(DISTINCT r.item_id), 5) AS w FROM authors_rels r JOIN d m ON m.item_id = r.item_id AND m.entity_type = 'part' GROUP BY 1, 2 HAVING count(DISTINCT r.item_id) >= 2),
    f AS (SELECT 1 AS k, 'entity_item' AS family, 'part:' || entity_id AS source, 'item:' || item_id AS target, 1.0 AS weight FROM d WHERE entity_type = 'part' UNION ALL SELECT 2, 'author_entity', 'author:' || author_id, 'part:' || entity_id, w FROM s
      UNION ALL SELECT 3, 'dataset_author', 'item:' || item_id, 'author:' || author_id, 3.0 FROM authors_rels WHERE collection = 'O' UNION ALL SELECT 4, 'dataset_publication', 'item:' || source_item, 'item:' || target_item, 4.0 FROM references_cited r JOIN items i ON i.item_id = r.source_item AND i.collection = 'O' WHERE target_item IS NOT NULL
      UNION ALL SELECT 5, 'citation', 'item:' || source_item, 'item:' || target_item, 6.0 FROM references_cited WHERE target_item IS NOT NULL)
    SELECT family, source, target, CAST(weight AS DOUBLE) AS weight FROM f QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY k, weight DESC, source) = 1""")
def gra06_more(t: Tables) -> DataFrame:
    """Five further families; of a pair that several have, the first one's edge stays."""
    edge = lambda df, s, d, w: df.select(s.alias("source"), d.alias("target"), w.cast("double").alias("weight"))
    mentions = t.entity_mentions().filter("entity_type = 'part'").select("entity_id", "item_id").distinct()
    rels, refs = t.authors_rels(), t.references_cited().filter("target_item is not null")
    both = rels.select("author_id", "item_id").join(mentions, "item_id").groupBy("author_id", "entity_id").agg(F.count_distinct("item_id").alias("n")).filter("n >= 2")
    datasets = t.items().filter("collection = 'O'").select(F.col("item_id").alias("source_item"))
    return graph.edge_families(
        {
            "entity_item": edge(mentions, name("part", "entity_id"), name("item", "item_id"), F.lit(1)),
            "author_entity": edge(both, name("author", "author_id"), name("part", "entity_id"), F.least("n", F.lit(5))),
            "dataset_author": edge(rels.filter("collection = 'O'"), name("item", "item_id"), name("author", "author_id"), F.lit(3)),
            "dataset_publication": edge(refs.join(datasets, "source_item", "left_semi"), name("item", "source_item"), name("item", "target_item"), F.lit(4)),
            "citation": edge(refs, name("item", "source_item"), name("item", "target_item"), F.lit(6)),
        }
    )


DOCUMENT_FAMILIES = """WITH m AS (SELECT DISTINCT entity_type, entity_id, collection, item_id FROM entity_mentions), k AS (SELECT item_id, collection FROM items),
    sh AS (SELECT a.item_id AS a, b.item_id AS b, a.collection AS ca, b.collection AS cb, least(count(*), 5) AS w FROM m a JOIN m b ON a.entity_type = 'part' AND b.entity_type = 'part' AND a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
    c AS (SELECT source_item AS s, target_item AS t, x.collection AS cs, y.collection AS ct FROM references_cited JOIN k x ON x.item_id = source_item JOIN k y ON y.item_id = target_item),
    f AS (SELECT 1 AS k, 'document_entity' AS family, 'item:' || item_id AS source, 'part:' || entity_id AS target, 1 AS weight FROM m WHERE collection = 'P' AND entity_type = 'part'
      UNION ALL SELECT 2, 'story_entity', 'item:' || item_id, 'part:' || entity_id, 1 FROM m WHERE collection = 'O' AND entity_type = 'part'
      UNION ALL SELECT 3, 'story_publication', 'item:' || s, 'item:' || t, 3 FROM c WHERE cs = 'O' AND ct = 'F' UNION ALL SELECT 3, 'story_publication', 'item:' || CASE WHEN ca = 'O' THEN a ELSE b END, 'item:' || CASE WHEN ca = 'O' THEN b ELSE a END, 1 FROM sh WHERE (ca, cb) IN (('O', 'F'), ('F', 'O'))
      UNION ALL SELECT 4, 'story_document', 'item:' || CASE WHEN ca = 'O' THEN a ELSE b END, 'item:' || CASE WHEN ca = 'O' THEN b ELSE a END, w FROM sh WHERE (ca, cb) IN (('O', 'P'), ('P', 'O'))
      UNION ALL SELECT 5, 'story_story', 'item:' || a, 'item:' || b, w FROM sh WHERE ca = 'O' AND cb = 'O' UNION ALL SELECT 6, 'stakeholder_item', 'supplier:' || entity_id, 'item:' || item_id, 1 FROM m WHERE entity_type = 'supplier'
      UNION ALL SELECT 7, 'document_publication', 'item:' || s, 'item:' || t, 6 FROM c WHERE cs = 'P' AND ct = 'F' UNION ALL SELECT 8, 'document_document', 'item:' || s, 'item:' || t, 6 FROM c WHERE cs = 'P' AND ct = 'P'
      UNION ALL SELECT 9, 'author_document', 'author:' || author_id, 'item:' || item_id, 3 FROM authors_rels WHERE collection = 'P')
    SELECT family, source, target, CAST(weight AS DOUBLE) AS weight FROM f QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY k, weight DESC, source) = 1"""


@query("gra06_document_families", DOCUMENT_FAMILIES)
def gra06_documents(t: Tables) -> DataFrame:
    """The nine families of documents (collection P), stories (O) and publications (F): mentions, the strongest link of a story and a
    publication (a citation before shared entities), shared entities with a cap, citations, authors."""
    edge = lambda df, s, d, w: df.select(s.alias("source"), d.alias("target"), w.cast("double").alias("weight"))
    item = lambda c: name("item", c)
    mentions = stored(t.entity_mentions().select("entity_type", "entity_id", "collection", "item_id").distinct(), "mentions")
    part = mentions.filter("entity_type = 'part'")
    kinds = lambda id, c: t.items().select(F.col("item_id").alias(id), F.col("collection").alias(c))
    shared = stored(graph.pair_counts(part, ["entity_id"], "item_id", 2), "shared").join(kinds("a", "ca"), "a").join(kinds("b", "cb"), "b")
    shared = stored(shared.withColumn("w", F.least("weight", F.lit(5))), "shared")
    cited = t.references_cited().filter("target_item is not null").join(kinds("source_item", "cs"), "source_item").join(kinds("target_item", "ct"), "target_item")
    first = lambda kind, other: shared.filter(F.col("ca") != F.col("cb")).filter(F.col("ca").isin(kind, other) & F.col("cb").isin(kind, other)).withColumns({"x": F.when(F.col("ca") == kind, F.col("a")).otherwise(F.col("b")), "y": F.when(F.col("ca") == kind, F.col("b")).otherwise(F.col("a"))})
    links = lambda s, d, w: edge(cited.filter((F.col("cs") == s) & (F.col("ct") == d)), item("source_item"), item("target_item"), F.lit(w))
    return graph.edge_families(
        {
            "document_entity": edge(part.filter("collection = 'P'"), item("item_id"), name("part", "entity_id"), F.lit(1)),
            "story_entity": edge(part.filter("collection = 'O'"), item("item_id"), name("part", "entity_id"), F.lit(1)),
            "story_publication": links("O", "F", 3).unionByName(edge(first("O", "F"), item("x"), item("y"), F.lit(1))),
            "story_document": edge(first("O", "P"), item("x"), item("y"), F.col("w")),
            "story_story": edge(shared.filter("ca = 'O' and cb = 'O'"), item("a"), item("b"), F.col("w")),
            "stakeholder_item": edge(mentions.filter("entity_type = 'supplier'"), name("supplier", "entity_id"), item("item_id"), F.lit(1)),
            "document_publication": links("P", "F", 6),
            "document_document": links("P", "P", 6),
            "author_document": edge(t.authors_rels().filter("collection = 'P'"), name("author", "author_id"), item("item_id"), F.lit(3)),
        }
    )


@query("gra11_carried_communities", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey % 7 END AS community FROM part")
def gra11(t: Tables) -> DataFrame:
    labels = t("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 7).alias("community"))
    return graph.with_communities(t("part").select("p_partkey"), labels, "p_partkey")


@query("gra12_subgraph", f"""WITH e AS MATERIALIZED (SELECT a, b, weight FROM ({PAIRS}) p), m AS (SELECT p_partkey AS node FROM part WHERE p_size < 20), x AS (SELECT a AS x, b AS node FROM e UNION ALL SELECT b, a FROM e),
    k AS (SELECT x.x AS node, count(*) AS n FROM x JOIN m USING (node) GROUP BY 1),
    o AS (SELECT k.node FROM k JOIN part ON p_partkey = k.node ANTI JOIN m USING (node) WHERE n >= 2 AND p_type LIKE 'S%'), n AS (SELECT node FROM m UNION ALL SELECT node FROM o)
    SELECT e.a, e.b, e.weight FROM e JOIN n na ON na.node = e.a JOIN n nb ON nb.node = e.b""")
def gra12(t: Tables) -> DataFrame:
    """The parts of small size, and outside parts of one type that have two edges or more to them."""
    part = t("part").select(F.col("p_partkey").alias("node"), "p_size", "p_type")
    return graph.subgraph(part_pairs(t, 1), part.filter("p_size < 20").select("node"), part.filter("p_type like 'S%'").select("node"))[1]


@query("rel01_vector_signal", f"""WITH {VECTORS}, s AS (SELECT b.vec_id AS target, 'vector' AS signal, round({COSINE}, 3) AS similarity, 1 AS n FROM v a JOIN v b ON a.vec_id = 5 AND b.vec_id <> 5 WHERE round({COSINE}, 3) > 0.1 ORDER BY similarity DESC, target LIMIT 15),
    g AS (SELECT target, max(similarity) AS sim, string_agg(DISTINCT signal, '+' ORDER BY signal) AS signals, count(DISTINCT signal) AS k FROM (SELECT * FROM s UNION ALL SELECT l_partkey, 'entities', least(1.0, ln(count(DISTINCT l_orderkey) + 1) / ln(30.0)), 1 FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5) AND l_partkey <> 5 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2) u GROUP BY 1)
    SELECT target, round(sim, 6) AS similarity, signals, round(sim + 0.15 * k, 6) AS score FROM g""")
def rel01_vector(t: Tables) -> DataFrame:
    """The fourth signal of related works: nearest vectors, merged with shared entities."""
    v = t("embeddings")
    near = vectors.nearest(v, v.filter("vec_id = 5"), over=0.1).select(F.col("vec_id").alias("target"), F.lit("vector").alias("signal"), "similarity", F.lit(1).cast("long").alias("n"))
    lines = t("lineitem").select("l_partkey", "l_orderkey")
    own = lines.filter("l_partkey = 5").select("l_orderkey").distinct()
    shared = lines.filter("l_partkey <> 5").join(own, "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("target")).agg(F.count_distinct("l_orderkey").alias("n")).filter("n >= 2")
    shared = shared.select("target", F.lit("entities").alias("signal"), related.log_proxy(F.col("n")).alias("similarity"), "n")
    return related.merged([near, shared]).select("target", "similarity", "signals", "score")


@query("rel02_project_assignment", f"""WITH {VECTORS}, s AS (SELECT b.vec_id AS id, {COSINE} AS sim FROM v a JOIN v b ON a.vec_id = 8 AND b.vec_id <> 8 WHERE {COSINE} > 0.15 ORDER BY round(sim, 9) DESC, id LIMIT 50),
    c AS (SELECT id, 0.4 * sim AS score FROM s UNION ALL SELECT DISTINCT l_partkey, 0.32 FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT p_partkey, 0.1 FROM part WHERE p_name LIKE '%ring%')
    SELECT id, round(sum(score), 6) AS score FROM c GROUP BY 1 HAVING sum(score) >= 0.3""")
def rel02(t: Tables) -> DataFrame:
    """Works of a project: 0.4 of the similarity, 0.32 for an author of it, 0.1 for the text; kept from 0.3 on."""
    v = t("embeddings")
    near = vectors.nearest_each(v.filter("vec_id = 8"), v, 50, 0.15).select(F.col("vec_id").alias("id"), (F.col("similarity") * 0.4).alias("score"))
    wrote = t("lineitem").filter("l_suppkey = 3").select(F.col("l_partkey").alias("id")).distinct().withColumn("score", F.lit(0.32))
    text = t("part").filter(F.col("p_name").contains("ring")).select(F.col("p_partkey").alias("id"), F.lit(0.1).alias("score"))
    return related.composite([near, wrote, text], "id", 0.3).withColumn("score", F.round("score", 6))


@query("rel06_cross_links", """SELECT link, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'matched' ELSE 'unmatched' END AS link FROM orders WHERE o_orderkey % 2 = 0) x GROUP BY 1""")
def rel06(t: Tables) -> DataFrame:
    """DOIs that publications name, against datasets: those that have one, and how many DOIs nobody has."""
    from tarn.functions import text as X

    named = t("orders").filter("o_orderkey % 2 = 0").select(F.expr("concat('data at https://doi.org/10.9/D', o_orderkey, '.')").alias("text"))
    have = t("orders").filter("o_orderkey % 4 = 0").select(F.expr("concat('10.9/d', o_orderkey)").alias("doi")).withColumn("known", F.lit(True))
    joined = named.select(F.lower(X.extract_doi(F.col("text"))).alias("doi")).join(have, "doi", "left")
    return joined.groupBy(F.when(F.col("known"), "matched").otherwise("unmatched").alias("link")).agg(F.count("*").alias("n"))


@query("smp01_quotas", """WITH s AS (SELECT c_mktsegment || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT *, greatest(2, least(floor(40 * n / sum(n) OVER () + 0.5), n)) AS share FROM s)
    SELECT k, n, CAST(CASE WHEN sum(n) OVER () <= 40 THEN n WHEN sum(share) OVER () > 40 THEN greatest(1, floor(share * 40 / sum(share) OVER ())) ELSE share END AS BIGINT) AS quota FROM q""")
def smp01_quotas(t: Tables) -> DataFrame:
    """Two at least in each of many strata is more than the cap, so quotas are scaled down."""
    sizes = t("customer").groupBy(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("k")).agg(F.count("*").alias("n"))
    return sync.quotas(sizes, "n", 40)


@query("smp03_eligible", """WITH c AS (SELECT owner_id, count(*) AS size, count(*) FILTER (collection = 'F') AS p, count(*) FILTER (collection = 'O') AS d, count(*) FILTER (subtype = '1-URGENT') AS s, count(*) FILTER (subtype = '5-LOW') AS k FROM items GROUP BY 1)
    SELECT owner_id, CAST(p * 3 + d * 2 + s + k * 0.5 AS DOUBLE) AS score, CASE WHEN p / (p + d + 1) > 0.7 THEN 'research' WHEN p / (p + d + 1) < 0.3 THEN 'policy' ELSE 'mixed' END AS kind FROM c
    WHERE size >= 8 AND (p >= 3 OR d >= 3 OR (s >= 10 AND k >= 5)) AND p * 3 + d * 2 + s + k * 0.5 >= 15""")
def smp03(t: Tables) -> DataFrame:
    """Gates on size and content; the table's groups are small, so the size asked for is 8."""
    of = F.count_if
    c = t.items().groupBy("owner_id").agg(F.count("*").alias("size"), of(F.col("collection") == "F").alias("p"), of(F.col("collection") == "O").alias("d"), of(F.col("subtype") == "1-URGENT").alias("s"), of(F.col("subtype") == "5-LOW").alias("k"))
    return related.eligible(c, 8).select("owner_id", "score", "kind")


@query("smp04_tiers", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY cites DESC, item_id) AS a FROM items), l AS (SELECT owner_id, item_id, 'landmark' AS tier FROM r WHERE a <= 3),
    n AS (SELECT owner_id, item_id, 'recent' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY year DESC, item_id) AS b FROM r WHERE a > 3) x WHERE b <= 3)
    SELECT * FROM l UNION ALL SELECT * FROM n""")
def smp04(t: Tables) -> DataFrame:
    """The most cited of each group, then the newest of the others."""
    landmark = browse.top_per_group(t.items(), ["owner_id"], [F.desc("cites"), F.col("item_id")], 3)
    rest = t.items().join(landmark.select("item_id"), "item_id", "left_anti")
    recent = browse.top_per_group(rest, ["owner_id"], [F.desc("year"), F.col("item_id")], 3)
    tier = lambda df, n: df.select("owner_id", "item_id", F.lit(n).alias("tier"))
    return tier(landmark, "landmark").unionByName(tier(recent, "recent"))


@query("rst04_flattened_steps", "SELECT p_partkey, CAST(CASE WHEN i = 1 AND p_partkey % 2 = 0 THEN 9 ELSE i END AS INTEGER) AS step, s AS text FROM (SELECT p_partkey, unnest([p_name, p_type]) AS s, unnest([1, 2]) AS i FROM part) x")
def rst04(t: Tables) -> DataFrame:
    """An explicit step number counts, else the place from 1."""
    steps = F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, 9).alias("number"), F.col("p_name").alias("text")), F.struct(F.lit(None).cast("int").alias("number"), F.col("p_type").alias("text")))
    flat = t("part").select("p_partkey", F.posexplode(steps).alias("i", "s"))
    return flat.select("p_partkey", F.coalesce("s.number", F.col("i") + 1).alias("step"), "s.text")


@query("rst07_open_locations", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'best.pdf' WHEN 1 THEN 'second.pdf' END AS pdf FROM part")
def rst07(t: Tables) -> DataFrame:
    """The best location where it has a PDF, else the first that has one."""
    k = F.col("p_partkey") % 3
    place = lambda pdf: F.struct(pdf.cast("string").alias("pdf"))
    best, others = F.when(k == 0, place(F.lit("best.pdf"))).when(k == 1, place(F.lit(None))), F.array(place(F.lit(None)), place(F.when(k < 2, "second.pdf")))
    every = F.concat(F.array(best), others)
    return t("part").select("p_partkey", F.get(F.filter(every, lambda x: x["pdf"].isNotNull()), F.lit(0))["pdf"].alias("pdf"))


@query("rst09_refreshed_counts", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 90 WHEN o_orderstatus = 'O' THEN 0 ELSE floor(o_totalprice / 1000) END AS BIGINT) AS cites FROM orders")
def rst09(t: Tables) -> DataFrame:
    """New counts where there are any; datasets without one have none; others keep theirs."""
    fresh = t("orders").filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderkey") % 90).alias("n"))
    joined = t.items().select(F.col("item_id").alias("o_orderkey"), "collection", "cites").join(fresh, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("n", F.when(F.col("collection") == "O", 0).otherwise(F.col("cites"))).alias("cites"))


@query("rst12_richer_text", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) * (doc_id % 3) >= length(coalesce(text, '')) + 100 THEN 'new' ELSE 'old' END AS kept FROM documents")
def rst12(t: Tables) -> DataFrame:
    """A new text replaces the old one only if it is longer by 100 characters or more."""
    old = F.coalesce("text", F.lit(""))
    new = F.repeat(old, (F.col("doc_id") % 3).cast("int"))
    return t("documents").select("doc_id", F.when(F.length(new) >= F.length(old) + 100, "new").otherwise("old").alias("kept"))


@query("rst18_author_browse", "SELECT s_suppkey, s_name, count(l_orderkey) AS works FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l ON l_suppkey = s_suppkey WHERE s_name LIKE 'S%' GROUP BY 1, 2 ORDER BY works DESC, s_suppkey LIMIT 20 OFFSET 5")
def rst18(t: Tables) -> DataFrame:
    works = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").distinct().groupBy("s_suppkey").agg(F.count("*").alias("works"))
    joined = t("supplier").filter(F.col("s_name").startswith("S")).join(works, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("works", F.lit(0)).alias("works"))
    return browse.page(joined, [F.desc("works"), F.col("s_suppkey")], 20, 5)


@query("rst23_map_layer", "SELECT c_custkey, c_acctbal / 100 AS lat, c_mktsegment AS kind FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rst23(t: Tables) -> DataFrame:
    """Places that have coordinates, of the chosen kinds."""
    placed = t("customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).alias("lat"), F.col("c_mktsegment").alias("kind"))
    return browse.where_all(placed, F.col("lat").isNotNull(), F.col("kind").isin("BUILDING", "MACHINERY"))


@query("rst24_client_filter", f"""WITH e AS (SELECT * FROM ({PAIRS}) p), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) x GROUP BY 1)
    SELECT p_type AS class, count(*) FILTER (degree >= 5 AND p_type <> 'PROMO') AS shown, count(*) FILTER (NOT (degree >= 5 AND p_type <> 'PROMO')) AS hidden FROM d JOIN part ON p_partkey = node GROUP BY 1""")
def rst24(t: Tables) -> DataFrame:
    """Nodes of enough degree and of shown classes, with the counts of both."""
    shown = (F.col("degree") >= 5) & (F.col("p_type") != "PROMO")
    nodes = graph.degrees(part_pairs(t, 1)).join(t("part").select(F.col("p_partkey").alias("node"), "p_type"), "node")
    return nodes.groupBy(F.col("p_type").alias("class")).agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("hidden"))


@query("rst25_theme_contributors", """SELECT theme, owner_id, n, rn FROM (SELECT c_mktsegment AS theme, owner_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, owner_id) AS INTEGER) AS rn FROM items JOIN customer ON c_custkey = owner_id GROUP BY 1, 2) x WHERE rn <= 10""")
def rst25(t: Tables) -> DataFrame:
    counts = t.items().groupBy("owner_id").agg(F.count("*").alias("n")).join(t("customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("theme")), "owner_id")
    return browse.top_per_group(counts, ["theme"], [F.desc("n"), F.col("owner_id")], 10).select("theme", "owner_id", "n", "rn")


@query("rst26_extraction_report", "SELECT event_type, count(*) AS processed, count(*) FILTER (value >= 10) AS extracted, count(*) FILTER (value < 1) AS errors, count(*) FILTER (value >= 1 AND value < 10) AS empty FROM events GROUP BY 1")
def rst26(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.count("*").alias("processed"), F.count_if(v >= 10).alias("extracted"), F.count_if(v < 1).alias("errors"), F.count_if((v >= 1) & (v < 10)).alias("empty"))

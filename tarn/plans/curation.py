"""Queries: merges by hand, nested results, topics, coloured graphs, what collections lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import browse, curation, graph
from tarn.plans.registry import query
from tarn.sources.tables import Tables


@query("ent15_merged_by_hand", """WITH m AS (SELECT p_partkey AS old_id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new_id FROM part)
    SELECT new_id AS entity_id, count(DISTINCT l_orderkey) AS items FROM lineitem JOIN m ON old_id = l_partkey GROUP BY 1""")
def ent15(t: Tables) -> DataFrame:
    """A list of merges (parts of one name and brand into the first of them) applied to the mentions."""
    first = t("part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("new_id"))
    merges = t("part").join(first, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("old_id"), "new_id")
    mentions = t("lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("item_id"))
    return curation.merged_by_hand(merges, {"mentions": (mentions, "entity_id")})["mentions"].groupBy("entity_id").agg(F.count("*").alias("items"))


@query("joi22_nested_statements", """WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (ORDER BY conv_id, turn, role, coalesce(text, '')) AS statement_id,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS position FROM conversations)
    SELECT conv_id, CAST(position AS INTEGER) AS position, statement_id, role, CAST(length(s.text) AS INTEGER) AS size, d.lang FROM s LEFT JOIN documents d ON d.doc_id = s.statement_id""")
def joi22(t: Tables) -> DataFrame:
    """Conversations as clusters with a JSON list of statements; the sequential id links a statement to the table of documents."""
    said = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    clusters = t("conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(said))).alias("statements"))
    rows = curation.numbered_statements(clusters, "conv_id", "statements", "turn long, role string, text string").withColumn("statement_id", F.col("statement_id").cast("long"))
    linked = rows.join(t("documents").select(F.col("doc_id").alias("statement_id"), "lang"), "statement_id", "left")
    return linked.select("conv_id", "position", "statement_id", "role", F.length("text").alias("size"), "lang")


TOPICS = [("licen[cs]e|copyright", "rights"), (r"\d{4}", "numbers"), ("@", "addresses"), ("thing", "things")]


@query("rst02_assigned_topics", "WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS x, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), a AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS topic FROM l WHERE regexp_matches(x, '{rule}')" for rule, name in TOPICS) + ") SELECT topic, lang, count(*) AS items FROM a GROUP BY 1, 2")
def rst02(t: Tables) -> DataFrame:
    """Topics of whole texts for documents without labels, and how they are distributed."""
    found = curation.assigned_topics(t("documents"), t("labels"), "doc_id", F.col("text"), TOPICS)
    return found.join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("topic", "lang").agg(F.count("*").alias("items"))


@query("rst16_lacking_items", """WITH l AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')),
    a AS (SELECT o_custkey AS c_custkey, o_orderpriority AS kind FROM orders UNION ALL SELECT c_custkey, '1-URGENT' FROM l)
    SELECT c_custkey, count(*) AS items, count(*) FILTER (kind = '1-URGENT') AS urgent FROM a GROUP BY 1""")
def rst16(t: Tables) -> DataFrame:
    """Customers without an urgent item get one, and then none lacks it."""
    items = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("kind"))
    targets = curation.lacking(t("customer").select("c_custkey"), items, "c_custkey", F.col("kind") == "1-URGENT")
    filled = items.unionByName(targets.withColumn("kind", F.lit("1-URGENT")))
    return filled.groupBy("c_custkey").agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "1-URGENT").alias("urgent"))


@query("rst20_projects", """SELECT c_mktsegment AS field, count(*) AS projects, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS budget FROM customer WHERE c_acctbal > 0 AND c_name ILIKE '%1%' AND c_custkey NOT IN (SELECT id FROM topics WHERE parent_id IS NOT NULL AND parent_id % 2 = 1)
    GROUP BY 1 ORDER BY projects DESC, field LIMIT 10""")
def rst20(t: Tables) -> DataFrame:
    """Projects by filters, without those that belong to a plan with an odd number; the ten largest fields."""
    children = t.topics().filter("parent_id % 2 = 1").select(F.col("id").alias("c_custkey"))
    rows = browse.where_all(t("customer"), F.col("c_acctbal") > 0, F.col("c_name").ilike("%1%")).join(children, "c_custkey", "left_anti")
    fields = rows.groupBy(F.col("c_mktsegment").alias("field")).agg(F.count("*").alias("projects"), F.round(F.sum("c_acctbal"), 2).alias("budget"))
    return browse.page(fields, [F.desc("projects"), F.col("field")], 10)


@query("gra16_author_graph", """WITH w AS (SELECT DISTINCT author_id, item_id, subtype FROM authors_rels JOIN items USING (item_id)), c AS (SELECT author_id, subtype, count(*) AS n FROM w GROUP BY 1, 2),
    a AS (SELECT author_id, CAST(sum(n) AS BIGINT) AS works, arg_min(subtype, (-n, subtype)) AS area FROM c GROUP BY 1),
    p AS (SELECT x.author_id AS a, y.author_id AS b FROM authors_rels x JOIN authors_rels y ON x.item_id = y.item_id AND x.author_id < y.author_id GROUP BY 1, 2 HAVING count(*) >= 2),
    d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) x GROUP BY 1)
    SELECT author_id, works, area, coalesce(degree, 0) AS degree, round(2.0 + ln(coalesce(degree, 0) + 1) * 3.0, 6) AS size FROM a LEFT JOIN d ON node = author_id""")
def gra16(t: Tables) -> DataFrame:
    """Authors with the area that most of their works have, and their degree among those they share two works or more with."""
    rels = t.authors_rels()
    areas = curation.coloured_nodes(rels.join(t.items().select("item_id", "subtype"), "item_id"), "author_id", "item_id", "subtype")
    degrees = graph.degrees(graph.pair_counts(rels, ["item_id"], "author_id", 2)).withColumnRenamed("node", "author_id")
    joined = areas.join(degrees, "author_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.withColumn("size", F.round(graph.node_size(F.col("degree")), 6))


@query("rst08_aligned_answers", """WITH f AS (SELECT o_custkey, max(o_orderkey) AS found FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
    SELECT coalesce(c_mktsegment, 'unknown') AS kind, count(*) AS checked, count(found) AS found FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY 1""")
def rst08(t: Tables) -> DataFrame:
    """Customers are asked for in one batch a nation; the answers come as a list by position, null where nothing was found."""
    found = t("orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("found"))
    batches = t("customer").join(found, "c_custkey", "left").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "found"))).alias("s"))
    asked, answers = batches.select("c_nationkey", F.col("s.c_custkey").alias("ids")), batches.select("c_nationkey", F.col("s.found").alias("found"))
    rows = curation.aligned(asked, answers, "c_nationkey", "ids", "found").join(t("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    return curation.found_by_kind(rows, "c_mktsegment")


LINES = "list({0} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)".format


@query("rst11_synthesised_summaries", f"""WITH l AS (SELECT l_orderkey, {LINES('p_name')} AS places, {LINES("{'name': p_type, 'role': l_returnflag}")} AS concepts, {LINES('l_linestatus || s_name')} AS agencies, count(*) FILTER (l_quantity > 25) AS works
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
    p AS (SELECT *, list_slice(list_filter(concepts, lambda c: c.role = 'R'), 1, 4) AS main FROM l),
    s AS (SELECT o_orderkey, o_orderpriority AS old, CASE o_orderstatus WHEN 'F' THEN 'Finished order' WHEN 'O' THEN 'O' ELSE 'P' END || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' (' || year(o_orderdate) || ')' END || '.'
      || coalesce(' Covers ' || array_to_string(list_slice(places, 1, 3), ', ') || '.', '') || coalesce(' Topics: ' || array_to_string(list_transform(CASE WHEN len(main) >= 2 THEN main ELSE list_slice(concepts, 1, 4) END, lambda c: c.name), ', ') || '.', '')
      || coalesce(' Agencies: ' || array_to_string(list_slice(agencies, 1, 3), ', ') || '.', '') || CASE WHEN works > 1 THEN ' Cites ' || works || ' external works.' WHEN works = 1 THEN ' Cites 1 external work.' ELSE '' END AS new FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
    SELECT o_orderkey, CASE WHEN length(new) > 20 THEN new ELSE old END AS summary FROM s""")
def rst11(t: Tables) -> DataFrame:
    """An order as a document: its parts are places, their types concepts (of returned lines the primary ones), suppliers agencies."""
    lines = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    role = F.when(F.col("l_returnflag") == "R", "primary topic").otherwise("")
    said = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "p_name", F.struct(F.col("p_type").alias("name"), role.alias("role")).alias("c"), F.concat("l_linestatus", "s_name").alias("s"))))
    made = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(said.alias("x"), F.count_if(F.col("l_quantity") > 25).alias("works"))
    docs = t("orders").join(made, "o_orderkey", "left")
    dates = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate").cast("string"))
    found = {"type": F.col("o_orderstatus"), "dates": dates, "places": F.col("x.p_name"), "concepts": F.coalesce("x.c", F.array().cast("array<struct<name:string,role:string>>")), "agencies": F.col("x.s"), "works": F.col("works")}
    new = curation.synthesised_summary(found, {"F": "Finished order"})
    return docs.select("o_orderkey", curation.replaced_summary(F.col("o_orderpriority"), new).alias("summary"))

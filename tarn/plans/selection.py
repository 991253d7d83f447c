"""Queries: predicates over names, arrays and places, projections, second-order aggregates, ranks, sets and nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import browse, selection
from tarn.plans.registry import query
from tarn.sources.tables import Tables


@query("flt03_array_member", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE list_contains([n_name, r_name], 'NATION_3') OR list_contains([n_name, r_name], '%NATION%')")
def flt03(t: Tables) -> DataFrame:
    """Whole elements are compared: a pattern matches itself only."""
    aliased = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("aliases", F.array("n_name", "r_name"))
    return aliased.filter(F.array_contains("aliases", "NATION_3") | F.array_contains("aliases", "%NATION%")).select("n_nationkey", "n_name")


@query("flt05_value_like_any", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: 'A Large Blue GADGET box' ILIKE '%' || w || '%')) > 0")
def flt05(t: Tables) -> DataFrame:
    """The query is the value, the array's elements are the patterns."""
    value = F.lit("A Large Blue GADGET box".lower())
    return t("part").filter(F.exists(F.split(F.lower("p_name"), " "), lambda w: value.contains(w))).select("p_partkey")


@query("flt10_title_exclusions", "SELECT item_id, title FROM items WHERE NOT (lower(title) IN ('1-urgent 7', '5-low 12') OR lower(title) LIKE '2-high 1%' OR lower(title) LIKE '%9')")
def flt10(t: Tables) -> DataFrame:
    return t.items().filter(~selection.title_excluded(F.col("title"), ["1-URGENT 7", "5-Low 12"], ["2-high 1%", "%9"])).select("item_id", "title")


@query("flt11_contains_none", """SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n FROM documents
    WHERE text IS NOT NULL AND (length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 = 0 AND (length(lower(text)) - length(replace(lower(text), 'token', ''))) / 5 = 0""")
def flt11(t: Tables) -> DataFrame:
    clean = t("documents").filter(selection.contains_none(F.col("text"), ["license", "token"]))
    return clean.select("doc_id", selection.occurrences(F.col("text"), "the").alias("n"))


JUNK = "CASE s_suppkey % 9 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'not specified in text' WHEN 2 THEN 'No species given' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'Unspecifiedly' WHEN 6 THEN 'spp.' ELSE s_name END"


@query("flt12_junk_names", f"SELECT s_suppkey, CASE WHEN s_suppkey % 9 IN (0, 1, 2, 3, 4, 6) THEN true ELSE false END AS junk FROM (SELECT s_suppkey, {JUNK} AS name FROM supplier) x")
def flt12(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", selection.junk_name(F.expr(JUNK)).alias("junk"))


@query("flt16_inside_box", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN true ELSE c_acctbal / 100 BETWEEN 10 AND 50 AND c_nationkey * 5.0 BETWEEN 20 AND 80 END AS inside,
    c_acctbal / 100 <= 50 AND c_acctbal / 100 + 2 >= 10 AND c_nationkey * 5.0 <= 80 AND c_nationkey * 5.0 + 3 >= 20 AS overlaps FROM customer""")
def flt16(t: Tables) -> DataFrame:
    box, lat, lon = (10.0, 20.0, 50.0, 80.0), F.col("c_acctbal") / 100, F.col("c_nationkey") * 5.0
    known = F.when(F.col("c_custkey") % 10 != 0, lat)
    return t("customer").select("c_custkey", selection.inside_box(known, lon, box).alias("inside"), selection.boxes_overlap(lat, lon, lat + 2, lon + 3, box).alias("overlaps"))


@query("flt17_validators", """SELECT doc_id, doc_id % 2 = 0 AS url, doc_id % 3 = 0 AS orcid, doc_id % 5 = 0 AS email FROM documents""")
def flt17(t: Tables) -> DataFrame:
    from tarn.functions import text as X

    url = F.expr("concat(if(doc_id % 2 = 0, 'https://', 'javascript:'), 'a.example/', doc_id)")
    orcid = F.expr("concat('0000-0002-1825-00', lpad(doc_id % 10, 1, '0'), if(doc_id % 3 = 0, 'X', ' '))")
    email = F.expr("concat('n', doc_id, if(doc_id % 5 = 0, '@', ' at '), 'a.example')")
    return t("documents").select("doc_id", X.valid_url(url).alias("url"), X.valid_orcid(orcid).alias("orcid"), X.valid_email(email).alias("email"))


@query("flt19_unprocessed", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT source_item FROM references_cited WHERE link_type = 'external') ORDER BY cites DESC, item_id LIMIT 200")
def flt19(t: Tables) -> DataFrame:
    done = t.references_cited().filter("link_type = 'external'").select(F.col("source_item").alias("item_id"))
    return selection.unprocessed(t.items(), done, "item_id", [F.desc("cites"), F.col("item_id")], 200).select("item_id")


@query("flt21_alignment", "SELECT count(*) FILTER (lower(p_type) || ' ' || lower(p_name) LIKE '%' || lower(split_part(p_name, ' ', 1)) || '%' AND lower(p_type) LIKE '%' || lower(split_part(p_name, ' ', 3)) || '%') AS aligned, count(*) AS total FROM part")
def flt21(t: Tables) -> DataFrame:
    both = selection.words_stand_in(F.concat_ws(" ", "p_type", "p_name"), F.col("p_name"), (1,)) & selection.words_stand_in(F.col("p_type"), F.col("p_name"), (3,))
    return t("part").agg(F.count_if(both).alias("aligned"), F.count("*").alias("total"))


@query("flt22_manifest_status", "SELECT event_type AS stage, count(*) AS n FROM events WHERE event_type IN ('click', 'error') AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 GROUP BY 1")
def flt22(t: Tables) -> DataFrame:
    wanted = t("events").filter(F.col("event_type").isin("click", "error") & (F.get_json_object("props", "$.k").cast("int") >= 50))
    return wanted.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))


@query("flt23_worklist", """SELECT doc_id, length(text) AS size FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 200 AND 20000 AND lang = 'en'
    AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def flt23(t: Tables) -> DataFrame:
    poor = t("labels").filter("quality = 0").select("doc_id")
    wanted = browse.where_all(t("documents"), F.col("text").isNotNull(), F.length("text").between(200, 20_000), F.col("lang") == "en")
    return wanted.join(poor, "doc_id", "left_anti").select("doc_id", F.length("text").cast("long").alias("size"))


@query("prj01_polymorphic_names", """SELECT m.entity_type, m.entity_id, CASE m.entity_type WHEN 'part' THEN (SELECT any_value(p_name) FROM part WHERE p_partkey = m.entity_id)
    WHEN 'supplier' THEN (SELECT any_value(s_name) FROM supplier WHERE s_suppkey = m.entity_id) END AS name, count(*) AS n FROM entity_mentions m GROUP BY 1, 2, 3""")
def prj01(t: Tables) -> DataFrame:
    """Counted by entity first, so that names are joined to one row an entity; each type goes to its own table."""
    counts = t.entity_mentions().groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"))
    part = t("part").select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    supplier = t("supplier").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    return counts.join(part.unionByName(supplier), ["entity_type", "entity_id"], "left").select("entity_type", "entity_id", "name", "n")


@query("prj02_truncated", "SELECT page_id, left(url, 20) AS url, CASE WHEN length(html) > 50 THEN left(html, 50) || '...' ELSE html END AS head FROM pages")
def prj02(t: Tables) -> DataFrame:
    head = F.when(F.length("html") > 50, F.concat(F.left("html", F.lit(50)), F.lit("..."))).otherwise(F.col("html"))
    return t("pages").select("page_id", F.left("url", F.lit(20)).alias("url"), head.alias("head"))


@query("prj04_meta_list", """SELECT item_id, array_to_string(list_filter([subtype, CASE WHEN year > 1995 THEN CAST(year AS VARCHAR) END, CASE WHEN cites > 200 THEN 'cited ' || cites ELSE '' END], lambda x: x IS NOT NULL AND x <> ''), ' / ') AS meta FROM items""")
def prj04(t: Tables) -> DataFrame:
    fields = F.array("subtype", F.when(F.col("year") > 1995, F.col("year").cast("string")), F.when(F.col("cites") > 200, F.concat(F.lit("cited "), F.col("cites").cast("string"))).otherwise(""))
    return t.items().select("item_id", F.array_join(F.filter(fields, lambda x: x.isNotNull() & (x != "")), " / ").alias("meta"))


@query("agg08_distinct_lists", "SELECT owner_id, string_agg(DISTINCT subtype, '|' ORDER BY subtype) AS subtypes, CAST(count(DISTINCT year) AS BIGINT) AS years FROM items GROUP BY 1")
def agg08(t: Tables) -> DataFrame:
    return t.items().groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("subtype")), "|").alias("subtypes"), F.count_distinct("year").alias("years"))


@query("agg13_distinct_projection", "SELECT DISTINCT author_id, collection FROM authors_rels")
def agg13(t: Tables) -> DataFrame:
    return t.authors_rels().select("author_id", "collection").distinct()


@query("agg18_top_tags", """WITH w AS (SELECT p_brand AS cluster, lower(w) AS tag FROM (SELECT p_brand, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) x),
    c AS (SELECT cluster, tag, count(*) AS n FROM w GROUP BY 1, 2) SELECT cluster, tag, n FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) <= 10""")
def agg18(t: Tables) -> DataFrame:
    tags = t("part").select(F.col("p_brand").alias("cluster"), F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tag"))
    counted = tags.groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    return browse.top_per_group(counted, ["cluster"], [F.desc("n"), F.col("tag")], 10).drop("rn")


@query("agg19_leverage", """WITH w AS (SELECT owner_id, subtype, CASE WHEN collection <> 'F' THEN 0.7 WHEN subtype = '1-URGENT' THEN 1.0 WHEN subtype = '2-HIGH' THEN 0.7 WHEN subtype = '3-MEDIUM' THEN 0.3 WHEN subtype = '5-LOW' THEN 0.1 ELSE 0.7 END AS w FROM items)
    SELECT owner_id, round(sum(w)::DOUBLE * count(DISTINCT subtype), 6) AS institutional, round((count(*) - sum(w)::DOUBLE) * count(DISTINCT subtype), 6) AS partnership FROM w GROUP BY 1""")
def agg19(t: Tables) -> DataFrame:
    """Weights by effort, of actions only; other items count 0.7."""
    effort = {"1-URGENT": 1.0, "2-HIGH": 0.7, "3-MEDIUM": 0.3, "5-LOW": 0.1}
    by_effort = reduce(lambda c, kv: c.when(F.col("subtype") == kv[0], kv[1]), effort.items(), F.when(F.col("collection") != "F", 0.7)).otherwise(0.7)
    sums = t.items().groupBy("owner_id").agg(F.sum(by_effort).alias("w"), F.count("*").alias("n"), F.count_distinct("subtype").alias("k"))
    return sums.select("owner_id", F.round(F.col("w") * F.col("k"), 6).alias("institutional"), F.round((F.col("n") - F.col("w")) * F.col("k"), 6).alias("partnership"))


@query("agg20_theme_rollup", """WITH c AS (SELECT owner_id, count(*) AS items, sum(cites) AS cites FROM items GROUP BY 1)
    SELECT c_nationkey AS theme, count(*) AS clusters, CAST(sum(items) AS BIGINT) AS items, CAST(sum(cites) AS BIGINT) AS cites, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments FROM c JOIN customer ON c_custkey = owner_id GROUP BY 1""")
def agg20(t: Tables) -> DataFrame:
    clusters = t.items().groupBy(F.col("owner_id").alias("c_custkey")).agg(F.count("*").alias("items"), F.sum("cites").alias("cites"))
    joined = clusters.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return joined.groupBy(F.col("c_nationkey").alias("theme")).agg(F.count("*").alias("clusters"), F.sum("items").alias("items"), F.sum("cites").alias("cites"), F.count_distinct("c_mktsegment").alias("segments"))


@query("agg23_fixed_buckets", """SELECT CASE WHEN l_discount < 0.02 THEN '<0.02' WHEN l_discount < 0.05 THEN '0.02-0.05' WHEN l_discount < 0.08 THEN '0.05-0.08' ELSE '>=0.08' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1""")
def agg23(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    bucket = F.when(d < 0.02, "<0.02").when(d < 0.05, "0.02-0.05").when(d < 0.08, "0.05-0.08").otherwise(">=0.08")
    return t("lineitem").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg24_strata", "SELECT subtype, CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) AS n, min(cites) AS least, max(cites) AS most FROM items GROUP BY 1, 2")
def agg24(t: Tables) -> DataFrame:
    return t.items().groupBy("subtype", browse.decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"), F.min("cites").alias("least"), F.max("cites").alias("most"))


@query("agg26_focus", """WITH c AS (SELECT owner_id, count(*) FILTER (collection = 'F') AS p, count(*) FILTER (collection = 'O') AS d, count(*) FILTER (collection = 'P') AS s FROM items GROUP BY 1)
    SELECT CASE WHEN p > d + s THEN 'research' WHEN d > p + s THEN 'policy' WHEN s > p + d THEN 'news' ELSE 'mixed' END AS focus, count(*) AS n FROM c GROUP BY 1""")
def agg26(t: Tables) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("F", "publication", "O", "document", "P", "story")))
    counts = t.items().groupBy("owner_id", F.element_at(kinds, F.col("collection")).alias("kind")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))
    return maps.groupBy(selection.focus(F.col("counts")).alias("focus")).agg(F.count("*").alias("n"))


@query("win02_composite_dedup", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, coalesce(l_partkey, 0), lower(coalesce(l_returnflag, '')) ORDER BY l_linenumber, l_suppkey, l_extendedprice) = 1""")
def win02(t: Tables) -> DataFrame:
    keyed = t("lineitem").withColumns({"_p": F.coalesce("l_partkey", F.lit(0)), "_f": F.lower(F.coalesce("l_returnflag", F.lit("")))})
    first = browse.first_per_group(keyed, ["l_orderkey", "_p", "_f"], [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return first.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("win07_best_of_title", "SELECT subtype, item_id, cites FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY cites DESC, item_id) = 1) x ORDER BY cites DESC, subtype LIMIT 3")
def win07(t: Tables) -> DataFrame:
    return selection.strongest_first(t.items(), ["subtype"], [F.desc("cites"), F.col("item_id")], [F.desc("cites"), F.col("subtype")], 3).select("subtype", "item_id", "cites")


@query("win08_entities_by_degree", """SELECT entity_type, entity_id, degree FROM (SELECT m.entity_type, m.entity_id, n.degree FROM entity_mentions m JOIN entity_names n USING (entity_type, entity_id) WHERE m.item_id = 7
    QUALIFY row_number() OVER (PARTITION BY m.entity_type, m.entity_id ORDER BY m.role) = 1) x ORDER BY degree DESC, entity_type, entity_id LIMIT 5""")
def win08(t: Tables) -> DataFrame:
    own = t.entity_mentions().filter("item_id = 7").select("entity_type", "entity_id").distinct()
    return own.join(t.entity_names(), ["entity_type", "entity_id"]).select("entity_type", "entity_id", "degree").orderBy(F.desc("degree"), "entity_type", "entity_id").limit(5)


@query("win10_renumbered", "SELECT item_id, row_number() OVER (ORDER BY cites DESC, item_id) AS new_id FROM items")
def win10(t: Tables) -> DataFrame:
    return selection.renumbered(t.items().select("item_id", "cites"), [-F.col("cites"), F.col("item_id")]).select("item_id", F.col("new_id").cast("long").alias("new_id"))


RANKED = """r AS (SELECT item_id, collection, title, year, CAST(cites AS DOUBLE) / 7 AS rank, CASE WHEN collection <> 'P' THEN cites END AS external,
    (SELECT count(*) FROM references_cited c WHERE c.target_item = i.item_id) AS internal FROM items i)"""
MODES = {
    "relevance": "rank DESC", "newest": "year DESC NULLS LAST", "oldest": "year ASC NULLS LAST", "title": "title ASC", "title-desc": "title DESC",
    "most-cited": "CASE WHEN collection <> 'P' THEN external ELSE rank END DESC NULLS LAST", "most-cited-internal": "CASE WHEN collection <> 'P' THEN internal ELSE rank END DESC NULLS LAST",
}


@query("srt01_sort_modes", f"WITH {RANKED} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, collection, item_id FROM r QUALIFY row_number() OVER (PARTITION BY collection ORDER BY {o}, item_id) <= 5" for m, o in MODES.items()))
def srt01(t: Tables) -> DataFrame:
    """Every mode in every collection; collection P has no citation counts and falls back to rank."""
    internal = t.references_cited().groupBy(F.col("target_item").alias("item_id")).agg(F.count("*").alias("internal"))
    rows = t.items().join(internal, "item_id", "left").withColumns({"internal": F.coalesce("internal", F.lit(0)), "rank": F.col("cites") / 7, "external": F.col("cites")})
    heads = []
    for mode in MODES:
        for of, cited in (("collection <> 'P'", True), ("collection = 'P'", False)):
            head = browse.top_per_group(rows.filter(of), ["collection"], selection.order_of(mode, cited), 5)
            heads.append(head.select(F.lit(mode).alias("mode"), "collection", "item_id"))
    return reduce(DataFrame.unionByName, heads)


@query("srt08_parents_first", """WITH RECURSIVE up AS (SELECT id, 0 AS level FROM topics WHERE parent_id IS NULL UNION ALL SELECT t.id, level + 1 FROM up JOIN topics t ON t.parent_id = up.id)
    SELECT id, level FROM up""")
def srt08(t: Tables) -> DataFrame:
    return selection.parents_first(t.topics(), "id", "parent_id").select("id", "level")


@query("srt09_priority_sequence", """SELECT k AS phase, item_id FROM (SELECT 1 AS k, item_id FROM items WHERE cites > 400 UNION ALL SELECT 2, item_id FROM items WHERE subtype = '1-URGENT' UNION ALL SELECT 3, item_id FROM items WHERE year = 1998) u
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k) = 1""")
def srt09(t: Tables) -> DataFrame:
    phases = [t.items().filter(c).select(F.lit(k).alias("phase"), "item_id") for k, c in enumerate(("cites > 400", "subtype = '1-URGENT'", "year = 1998"), 1)]
    return reduce(DataFrame.unionByName, phases).groupBy("item_id").agg(F.min("phase").alias("phase"))


@query("set02_branches_with_limits", """SELECT * FROM (SELECT 'item' AS kind, item_id AS id, cites AS score FROM items ORDER BY cites DESC, item_id LIMIT 5) a
    UNION ALL SELECT * FROM (SELECT 'part', p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 7) b UNION ALL SELECT * FROM (SELECT 'author', s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 3) c""")
def set02(t: Tables) -> DataFrame:
    head = lambda df, kind, id, score, n: df.select(F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(score).cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(n)
    return head(t.items(), "item", "item_id", "cites", 5).unionByName(head(t("part"), "part", "p_partkey", "p_size", 7)).unionByName(head(t("supplier"), "author", "s_suppkey", "s_nationkey", 3))


@query("set03_folded_union", """SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS words FROM part GROUP BY 1""")
def set03(t: Tables) -> DataFrame:
    """Distinct words are folded by the aggregation, not gathered first."""
    words = t("part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    return words.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("words"))


@query("set06_array_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))), ',') AS fields FROM part")
def set06(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))), ",").alias("fields"))


@query("arr02_members", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, list_contains(string_split(p_name, ' '), 'ring') AS has FROM part")
def arr02(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t("part").select("p_partkey", F.get(words, F.lit(0)).alias("head"), F.size(words).alias("n"), F.array_contains(words, "ring").alias("has"))


@query("arr03_fold_arrays", "SELECT collection, string_agg(DISTINCT author_id::VARCHAR, ',' ORDER BY author_id::VARCHAR) AS authors FROM authors_rels GROUP BY 1")
def arr03(t: Tables) -> DataFrame:
    """Arrays of items are folded into one of distinct members: exploded, made distinct, gathered once."""
    arrays = t.authors_rels().groupBy("collection", "item_id").agg(F.collect_set("author_id").alias("a"))
    members = arrays.select("collection", F.explode("a").alias("a")).select("collection", F.col("a").cast("string").alias("a")).distinct()
    return members.groupBy("collection").agg(F.array_join(F.sort_array(F.collect_list("a")), ",").alias("authors"))


@query("arr05_key_parts", "SELECT key, split_part(key, ':', 1) AS kind, CAST(split_part(key, ':', 2) AS BIGINT) AS id FROM (SELECT DISTINCT entity_type || ':' || entity_id AS key FROM entity_mentions) k")
def arr05(t: Tables) -> DataFrame:
    keys = t.entity_mentions().select(F.concat_ws(":", "entity_type", F.col("entity_id").cast("string")).alias("key")).distinct()
    return keys.select("key", F.split_part("key", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("key", F.lit(":"), F.lit(2)).cast("long").alias("id"))


@query("dat03_intervals", "SELECT event_type, count(*) FILTER (ts >= m - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (ts < m - INTERVAL 3 DAY) AS older FROM events, (SELECT max(ts) AS m FROM events) x GROUP BY 1")
def dat03(t: Tables) -> DataFrame:
    last = F.broadcast(t("events").agg(F.max("ts").alias("m")))  # one row
    joined = t("events").crossJoin(last)
    return joined.groupBy("event_type").agg(F.count_if(F.col("ts") >= F.col("m") - F.expr("INTERVAL 24 HOURS")).alias("last_day"), F.count_if(F.col("ts") < F.col("m") - F.expr("INTERVAL 3 DAYS")).alias("older"))


@query("dat04_parsed_dates", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN item_id % 4 = 0 THEN NULL ELSE year END AS year FROM items JOIN orders ON o_orderkey = item_id""")
def dat04(t: Tables) -> DataFrame:
    from tarn.functions import text as X

    written = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    year = F.when(F.col("o_orderkey") % 4 == 0, "2999").otherwise(F.concat(F.lit("c. "), F.year("o_orderdate").cast("string"), F.lit("?")))
    return t("orders").select(F.col("o_orderkey").alias("item_id"), X.parsed_date(written).alias("day"), X.parsed_year(year).alias("year"))


NESTED = """'{"type":"publication","statements":["' || p_name || '","",null,"' || p_type || '"],"n":' || p_size || ',"inner":{"a":' || p_partkey || '}}'"""


@query("map02_flattened", "SELECT p_partkey, unnest([p_name, p_type]) AS statement FROM part")
def map02(t: Tables) -> DataFrame:
    statements = F.from_json(F.expr(NESTED), "statements array<string>")["statements"]
    return t("part").select("p_partkey", F.explode(F.filter(statements, lambda s: s.isNotNull() & (s != ""))).alias("statement"))


@query("map03_any_key", "SELECT p_partkey, p_size > 25 AS contains, p_partkey % 2 = 0 AS any_key FROM part")
def map03(t: Tables) -> DataFrame:
    from tarn.functions import nested as N

    curated = F.expr("map('name', if(p_size > 25, 'x', 'y'), if(p_partkey % 2 = 0, 'title', 'other'), '1')")
    return t("part").select("p_partkey", N.contains_entries(curated, {"name": "x"}).alias("contains"), N.has_any_key(curated, ["title", "year"]).alias("any_key"))


@query("map04_merged", "SELECT p_partkey, p_brand AS brand, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS name FROM part")
def map04(t: Tables) -> DataFrame:
    from tarn.functions import nested as N

    merged = N.merged_maps(F.expr("map('brand', p_brand, 'name', p_name)"), F.expr("if(p_partkey % 3 = 0, map('name', 'new', 'kind', p_type), map('kind', p_type))"))
    return t("part").select("p_partkey", merged["brand"].alias("brand"), merged["kind"].alias("kind"), merged["name"].alias("name"))


@query("map05_typed_json", """SELECT p_partkey, k AS field, CASE k WHEN 'statements' THEN 'array' WHEN 'n' THEN 'number' WHEN 'inner' THEN 'object' ELSE 'string' END AS kind FROM part, (SELECT unnest(['type', 'statements', 'n', 'inner']) AS k) x""")
def map05(t: Tables) -> DataFrame:
    from tarn.functions import nested as N

    whole = F.expr(NESTED)
    return t("part").select("p_partkey", F.explode(F.json_object_keys(whole)).alias("field"), whole.alias("j")).select("p_partkey", "field", N.json_type("j", "field").alias("kind"))


@query("map06_counts_by_type", "SELECT owner_id, CAST(count(*) FILTER (collection = 'F') AS BIGINT) AS publications, CAST(count(*) FILTER (collection = 'none') AS BIGINT) AS species FROM items GROUP BY 1")
def map06(t: Tables) -> DataFrame:
    counts = t.items().groupBy("owner_id", "collection").agg(F.count("*").alias("n")).groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("collection", "n"))).alias("m"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return counts.select("owner_id", of("F").alias("publications"), of("none").alias("species"))

"""Queries: scans, filters, facets, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import browse
from tarn.plans.registry import query
from tarn.sources.tables import Tables


@query("src02_point_lookup", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = 7")
def src02(t: Tables) -> DataFrame:
    return t.lookup("author", [7])


@query("src03_bulk_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 9, 1000000)")
def src03(t: Tables) -> DataFrame:
    return t.lookup("part", [1, 5, 9, 1_000_000]).select("p_partkey", "p_name")


@query("flt01_dynamic_filter", "SELECT item_id, title, year, cites FROM items WHERE collection = 'F' AND year >= 1994 AND year <= 1996 AND cites > 100")
def flt01(t: Tables) -> DataFrame:
    wanted = browse.where_all(t.items(), F.col("collection") == "F", F.col("year") >= 1994, F.col("year") <= 1996, None, F.col("cites") > 100)
    return wanted.select("item_id", "title", "year", "cites")


@query("flt02_contains", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%1%' AND (lower(p_type) LIKE '%an%' OR lower(p_brand) LIKE '%an%')")
def flt02(t: Tables) -> DataFrame:
    return t("part").filter(browse.contains_any("1", "p_name") & browse.contains_any("AN", "p_type", "p_brand")).select("p_partkey", "p_name", "p_type")


@query("flt04_array_contains", """SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE len(list_filter([lower(n_name), lower(r_name)], lambda x: contains(x, 'a'))) > 0""")
def flt04(t: Tables) -> DataFrame:
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("aliases", F.array("n_name", "r_name"))
    return joined.filter(browse.array_contains_text("aliases", "A")).select("n_nationkey", "n_name")


@query("flt07_semi_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def flt07(t: Tables) -> DataFrame:
    nations = t("nation").filter("n_regionkey = 1")
    return t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("flt08_null_safe", """WITH n AS (SELECT source_item, target_item, CASE WHEN source_item % 3 = 0 THEN NULL ELSE target_item END AS other FROM references_cited)
    SELECT source_item, target_item IS NOT DISTINCT FROM other AS same FROM n WHERE target_item IS NOT DISTINCT FROM other OR source_item % 2 = 0""")
def flt08(t: Tables) -> DataFrame:
    """Two nulls are the same, a null and a value are not."""
    other = F.when(F.col("source_item") % 3 != 0, F.col("target_item"))
    same = F.col("target_item").eqNullSafe(other)
    return t.references_cited().filter(same | (F.col("source_item") % 2 == 0)).select("source_item", same.alias("same"))


@query("flt09_quantile_filter", """WITH q AS (SELECT quantile_cont(cites, 0.25) AS low, quantile_cont(cites, 0.75) AS high FROM items)
    SELECT item_id, cites, CASE WHEN cites < low THEN 'low' WHEN cites >= high THEN 'high' ELSE 'middle' END AS band FROM items, q""")
def flt09(t: Tables) -> DataFrame:
    items = t.items()
    low, high = items.agg(F.percentile("cites", 0.25), F.percentile("cites", 0.75)).first()
    band = F.when(F.col("cites") < low, "low").when(F.col("cites") >= high, "high").otherwise("middle")
    return items.select("item_id", "cites", band.alias("band"))


@query("flt20_regex", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[1-3][0-9]?$') AND NOT regexp_matches(p_brand, '#1$')")
def flt20(t: Tables) -> DataFrame:
    return t("part").filter(F.col("p_brand").rlike("#[1-3][0-9]?$") & ~F.col("p_brand").rlike("#1$")).select("p_partkey", "p_brand")


@query("prj03_labels", "SELECT item_id, CASE collection WHEN 'F' THEN 'Publication' WHEN 'O' THEN 'Dataset' ELSE 'Item' END AS label FROM items")
def prj03(t: Tables) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("Publication"), F.lit("O"), F.lit("Dataset"))
    return t.items().select("item_id", F.coalesce(F.try_element_at(names, "collection"), F.lit("Item")).alias("label"))


@query("prj05_weighted_score", """SELECT i.item_id, i.cites * 2 + coalesce(m.n, 0) + 3 * coalesce(r.n, 0) AS score FROM items i
    LEFT JOIN (SELECT item_id, count(*) AS n FROM entity_mentions GROUP BY 1) m USING (item_id)
    LEFT JOIN (SELECT target_item, count(*) AS n FROM references_cited GROUP BY 1) r ON r.target_item = i.item_id""")
def prj05(t: Tables) -> DataFrame:
    mentions = t.entity_mentions().groupBy("item_id").agg(F.count("*").alias("m"))
    cited = t.references_cited().groupBy(F.col("target_item").alias("item_id")).agg(F.count("*").alias("r"))
    joined = t.items().join(mentions, "item_id", "left").join(cited, "item_id", "left")
    return joined.select("item_id", (F.col("cites") * 2 + F.coalesce("m", F.lit(0)) + 3 * F.coalesce("r", F.lit(0))).alias("score"))


@query("agg02_distinct_pairs", "SELECT entity_type, count(DISTINCT collection || ':' || item_id) AS works FROM entity_mentions GROUP BY 1")
def agg02(t: Tables) -> DataFrame:
    return t.entity_mentions().groupBy("entity_type").agg(F.count_distinct("collection", "item_id").alias("works"))


@query("agg03_facet", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def agg03(t: Tables) -> DataFrame:
    return browse.facet(t("part"), "p_type", "value", 5)


@query("agg04_array_facet", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) w GROUP BY 1""")
def agg04(t: Tables) -> DataFrame:
    return browse.facet(t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")), "w", "word")


@query("agg05_decades", "SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) AS n FROM items GROUP BY 1")
def agg05(t: Tables) -> DataFrame:
    return browse.facet(t.items(), browse.decade(F.col("year")), "decade")


@query("agg06_having", "SELECT entity_id, count(DISTINCT item_id) AS shared FROM entity_mentions WHERE entity_type = 'part' GROUP BY 1 HAVING count(DISTINCT item_id) >= 40")
def agg06(t: Tables) -> DataFrame:
    return t.entity_mentions().filter("entity_type = 'part'").groupBy("entity_id").agg(F.count_distinct("item_id").alias("shared")).filter("shared >= 40")


@query("agg07_filtered", """SELECT subtype, count(*) FILTER (collection = 'F') AS publications, count(*) FILTER (collection <> 'F') AS others,
    count(DISTINCT owner_id) FILTER (cites > 200) AS owners FROM items GROUP BY 1""")
def agg07(t: Tables) -> DataFrame:
    owner = F.when(F.col("cites") > 200, F.col("owner_id"))
    return t.items().groupBy("subtype").agg(F.count_if(F.col("collection") == "F").alias("publications"), F.count_if(F.col("collection") != "F").alias("others"), F.count_distinct(owner).alias("owners"))


@query("agg09_ordered_lists", """SELECT item_id, string_agg(CAST(author_id AS VARCHAR), '; ' ORDER BY ord) AS authors FROM authors_rels GROUP BY 1""")
def agg09(t: Tables) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "author_id"))), lambda s: s["author_id"].cast("string"))
    return t.authors_rels().groupBy("item_id").agg(F.array_join(ordered, "; ").alias("authors"))


@query("agg10_summary", "SELECT collection, count(*) AS n, min(year) AS first_year, max(year) AS last_year, max(cites) AS most FROM items GROUP BY 1")
def agg10(t: Tables) -> DataFrame:
    return t.items().groupBy("collection").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("cites").alias("most"))


@query("agg11_percentiles", """SELECT quantile_cont(cites, 0.25) AS q25, quantile_cont(cites, 0.5) AS q50, quantile_cont(cites, 0.75) AS q75,
    CAST(quantile_disc(cites, 0.5) AS DOUBLE) AS d50, max(cites) AS most FROM items""")
def agg11(t: Tables) -> DataFrame:
    return t.items().agg(*(F.percentile("cites", q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.expr("cast(percentile_disc(0.5) within group (order by cites) as double)").alias("d50"), F.max("cites").alias("most"))


@query("agg12_dashboard", """SELECT (SELECT count(*) FROM items WHERE collection = 'F') AS publications, (SELECT count(*) FROM supplier) AS authors,
    (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM references_cited WHERE link_type = 'internal') AS links""")
def agg12(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [one(t.items().filter("collection = 'F'"), "publications"), one(t("supplier"), "authors"), one(t("part"), "parts"), one(t("documents"), "documents"), one(t.references_cited().filter("link_type = 'internal'"), "links")]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(row)  # one row each
    return out


@query("agg14_most_common", """SELECT owner_id, subtype FROM (SELECT owner_id, subtype, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, subtype) AS rn
    FROM items GROUP BY 1, 2) x WHERE rn = 1""")
def agg14(t: Tables) -> DataFrame:
    return browse.most_common(t.items(), "owner_id", "subtype")


@query("agg15_distribution", """SELECT collection, string_agg(subtype || '=' || n, ', ' ORDER BY subtype) AS distribution
    FROM (SELECT collection, subtype, count(*) AS n FROM items GROUP BY 1, 2) c GROUP BY 1""")
def agg15(t: Tables) -> DataFrame:
    counts = t.items().groupBy("collection", "subtype").agg(F.count("*").alias("n"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("subtype", "n"))), lambda s: F.concat(s["subtype"], F.lit("="), s["n"].cast("string")))
    return counts.groupBy("collection").agg(F.array_join(entries, ", ").alias("distribution"))


@query("agg17_priority", """SELECT owner_id, round(ln(1 + count(*)) * (1 + avg(cites)) * ln(1 + count(DISTINCT subtype)), 6) AS priority FROM items GROUP BY 1""")
def agg17(t: Tables) -> DataFrame:
    return t.items().groupBy("owner_id").agg(F.round(F.log1p(F.count("*")) * (1 + F.avg("cites")) * F.log1p(F.count_distinct("subtype")), 6).alias("priority"))


@query("agg21_counters", """SELECT s_suppkey, coalesce(n, 0) AS work_count FROM supplier LEFT JOIN (SELECT author_id, count(*) AS n FROM authors_rels WHERE collection = 'P' GROUP BY 1) w
    ON author_id = s_suppkey""")
def agg21(t: Tables) -> DataFrame:
    works = t.authors_rels().filter("collection = 'P'").groupBy(F.col("author_id").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t("supplier").join(works, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("work_count"))


@query("agg22_size_stats", """WITH s AS (SELECT owner_id, count(*) AS n FROM items GROUP BY 1), l AS (SELECT list(n ORDER BY n DESC) AS sizes FROM s)
    SELECT len(sizes) AS groups, sizes[1] AS largest, sizes[CAST(floor(len(sizes) / 2) AS BIGINT) + 1] AS median FROM l""")
def agg22(t: Tables) -> DataFrame:
    sizes = t.items().groupBy("owner_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("many"))
    upto = F.sum("many").over(W.orderBy(F.desc("n")))  # one row for each distinct size
    total = sizes.agg(F.sum("many").alias("groups"), F.max("n").alias("largest"))
    placed = sizes.withColumn("upto", upto).join(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("groups") / 2))
    return placed.groupBy("groups", "largest").agg(F.max("n").alias("median"))


@query("agg25_coverage", """SELECT collection, count(*) AS total, count(*) FILTER (has) AS present FROM (SELECT 'documents' AS collection, length(text) > 200 AS has FROM documents
    UNION ALL SELECT 'pages', length(html) > 200 FROM pages UNION ALL SELECT 'benchmark', length(text) > 200 FROM benchmark) c GROUP BY 1""")
def agg25(t: Tables) -> DataFrame:
    branches = {"documents": t("documents").select("text"), "pages": t("pages").select(F.col("html").alias("text")), "benchmark": t("benchmark").select("text")}
    return browse.coverage(branches, F.length("text") > 200)


@query("win01_dedup", """SELECT owner_id, item_id FROM (SELECT owner_id, item_id, row_number() OVER (PARTITION BY owner_id ORDER BY length(title) DESC, item_id) AS rn FROM items) x WHERE rn = 1""")
def win01(t: Tables) -> DataFrame:
    return browse.first_per_group(t.items(), ["owner_id"], [F.desc(F.length("title")), F.col("item_id")]).select("owner_id", "item_id")


@query("win03_two_level_rank", """WITH c AS (SELECT collection, subtype, owner_id, count(*) AS n FROM items GROUP BY 1, 2, 3),
    a AS (SELECT *, row_number() OVER (PARTITION BY collection, subtype ORDER BY n DESC, owner_id) ::INTEGER AS type_rn FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY type_rn, n DESC, subtype)::INTEGER AS rn FROM a WHERE type_rn <= 5)
    SELECT collection, subtype, owner_id, n, type_rn, rn FROM b WHERE rn <= 4""")
def win03(t: Tables) -> DataFrame:
    counts = t.items().groupBy("collection", "subtype", "owner_id").agg(F.count("*").alias("n"))
    inner = browse.top_per_group(counts, ["collection", "subtype"], [F.desc("n"), F.col("owner_id")], 5, "type_rn")
    return browse.top_per_group(inner, ["collection"], [F.col("type_rn"), F.desc("n"), F.col("subtype")], 4)


@query("win04_relative_threshold", """WITH c AS (SELECT collection, owner_id, count(*) AS n FROM items GROUP BY 1, 2)
    SELECT collection, owner_id, n FROM c QUALIFY n >= 3 AND n >= 0.3 * max(n) OVER (PARTITION BY collection)""")
def win04(t: Tables) -> DataFrame:
    counts = t.items().groupBy("collection", "owner_id").agg(F.count("*").alias("n"))
    return counts.withColumn("m", F.max("n").over(W.partitionBy("collection"))).filter("n >= 3 and n >= 0.3 * m").drop("m")


@query("win11_slugs", """WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS rn FROM s)
    SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM r""")
def win11(t: Tables) -> DataFrame:
    base = t("part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("base"))
    rn = F.row_number().over(W.partitionBy("base").orderBy("p_partkey"))
    return base.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("rn").cast("string"))).alias("slug"))


@query("srt02_merged_page", """SELECT collection, item_id, coalesce(year, 0) AS year FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY year DESC NULLS LAST, item_id) AS rn FROM items) x
    WHERE rn <= 10 ORDER BY coalesce(year, 0) DESC, item_id LIMIT 10""")
def srt02(t: Tables) -> DataFrame:
    heads = browse.top_per_group(t.items(), ["collection"], [F.desc_nulls_last("year"), F.col("item_id")], 10)
    return browse.page(heads.select("collection", "item_id", F.coalesce("year", F.lit(0)).alias("year")), [F.desc("year"), F.col("item_id")], 10)


@query("srt03_paging", "SELECT item_id, cites FROM items ORDER BY cites DESC, item_id LIMIT 100 OFFSET 30")
def srt03(t: Tables) -> DataFrame:
    return browse.page(t.items().select("item_id", "cites"), [F.desc("cites"), F.col("item_id")], 500, 30)


@query("srt04_page_allocation", """WITH c AS (SELECT collection, count(*) AS n FROM items GROUP BY 1)
    SELECT collection, n, CASE WHEN n > 0 THEN CAST(greatest(1, round(20 * n / (SELECT sum(n) FROM c))) AS INTEGER) ELSE 0 END AS page_rows FROM c""")
def srt04(t: Tables) -> DataFrame:
    return browse.proportional_pages(t.items().groupBy("collection").agg(F.count("*").alias("n")), 20)


@query("set04_intersect", """SELECT count(DISTINCT entity_id) AS shared FROM (SELECT entity_type, entity_id FROM entity_mentions WHERE collection = 'F'
    INTERSECT SELECT entity_type, entity_id FROM entity_mentions WHERE collection = 'O') x""")
def set04(t: Tables) -> DataFrame:
    of = lambda c: t.entity_mentions().filter(F.col("collection") == c).select("entity_type", "entity_id")
    return of("F").intersect(of("O")).agg(F.count_distinct("entity_id").alias("shared"))


@query("set05_difference", """SELECT 'removed' AS change, c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 7 = 0
    UNION ALL SELECT 'added', c_custkey FROM customer WHERE c_custkey % 10 = 3 AND c_custkey % 7 <> 0""")
def set05(t: Tables) -> DataFrame:
    ids = t("customer").select(F.col("c_custkey").alias("id"))
    local, remote = ids.filter("id % 10 <> 3"), ids.filter("id % 7 <> 0")
    gone, new = local.join(remote, "id", "left_anti"), remote.join(local, "id", "left_anti")
    return gone.select(F.lit("removed").alias("change"), "id").unionByName(new.select(F.lit("added").alias("change"), "id"))


@query("set07_lineage", """WITH RECURSIVE up AS (SELECT id AS leaf, id AS ancestor, 0 AS depth FROM topics
    UNION ALL SELECT leaf, parent_id, depth + 1 FROM up JOIN topics ON id = ancestor WHERE parent_id IS NOT NULL AND depth < 5)
    SELECT leaf, ancestor, depth FROM up""")
def set07(t: Tables) -> DataFrame:
    return browse.lineage(t.topics(), "id", "parent_id")


@query("win06_deepest_ancestor", """WITH RECURSIVE up AS (SELECT id AS leaf, id AS ancestor, 0 AS depth FROM topics
    UNION ALL SELECT leaf, parent_id, depth + 1 FROM up JOIN topics ON id = ancestor WHERE parent_id IS NOT NULL AND depth < 5)
    SELECT leaf, ancestor FROM up QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY depth DESC, ancestor) = 1""")
def win06(t: Tables) -> DataFrame:
    return browse.first_per_group(browse.lineage(t.topics(), "id", "parent_id"), ["leaf"], [F.desc("depth"), F.col("ancestor")]).select("leaf", "ancestor")


@query("rst19_most_cited_first", """SELECT item_id, cites, year FROM items WHERE owner_id = 1 ORDER BY cites > 0 DESC, cites DESC, year DESC, item_id""")
def rst19(t: Tables) -> DataFrame:
    return t.items().filter("owner_id = 1").select("item_id", "cites", "year").orderBy(F.desc(F.col("cites") > 0), F.desc("cites"), F.desc("year"), "item_id")


@query("ver02_staleness", """SELECT collection, count(*) FILTER (year < 1995) AS stale, CASE WHEN count(*) FILTER (year < 1995) * 2 > count(*) THEN 'stale' ELSE 'fresh' END AS status FROM items GROUP BY 1""")
def ver02(t: Tables) -> DataFrame:
    old = F.count_if(F.col("year") < 1995)
    return t.items().groupBy("collection").agg(old.alias("stale"), F.when(old * 2 > F.count("*"), "stale").otherwise("fresh").alias("status"))

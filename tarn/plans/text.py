"""Queries: text functions, search, resolution, vectors, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import resolve, search, sync, vectors
from tarn.plans.registry import query
from tarn.sources.tables import Tables

NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '<[^>]*>', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("str01_title_similarity", f"""WITH n AS (SELECT p_partkey, {NORMAL.format('p_name')} AS a, {NORMAL.format('p_type')} AS b FROM part),
    w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM n)
    SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS similarity FROM w""")
def str01(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.round(X.title_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("str07_strip_html", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s ]+', ' ', 'g')), '') AS text FROM pages""")
def str07(t: Tables) -> DataFrame:
    return t("pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("str08_article_text")
def str08(t: Tables) -> DataFrame:
    return t("pages").select("page_id", X.article_text(F.col("html")).alias("text"))


@query("str20_slug", "SELECT item_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM items")
def str20(t: Tables) -> DataFrame:
    return t.items().select("item_id", X.slug(F.col("title")).alias("slug"))


@query("str28_trigram", r"""WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', CAST(i AS INTEGER), 3))))) AS x,
    list_distinct(flatten(list_transform(string_split(lower(p_type), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', CAST(i AS INTEGER), 3))))) AS y FROM part)
    SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM g""")
def str28(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.round(X.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("str29_levenshtein", "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def str29(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.round(X.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("str37_chunks", """SELECT doc_id, k, substring(text, CAST(k * 2700 + 1 AS INTEGER), 3000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 3000) / 2700)) AS BIGINT) + 1)) AS k FROM documents) x""")
def str37(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 3000, 300)).alias("k", "chunk")).withColumn("k", F.col("k").cast("long"))


@query("str40_snippet")
def str40(t: Tables) -> DataFrame:
    return t("documents").filter(F.lower("text").contains("trash")).select("doc_id", search.snippet(F.col("text"), ["trash"]).alias("snippet"))


@query("map01_json_path", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def map01(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("fts02_match_all", """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'thing') GROUP BY 1, 2)
    SELECT doc_id AS id, round(sum(0.2 * tf / (tf + 1)), 6) AS score FROM c GROUP BY 1 HAVING count(*) = 2""")
def fts02(t: Tables) -> DataFrame:
    return search.match_all(search.index(t("documents"), "doc_id", {"C": "text"}), ["the", "thing"])


@query("fts03_phrase", """SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ', ' of the ')""")
def fts03(t: Tables) -> DataFrame:
    return search.match_phrase(t("documents"), "doc_id", "text", ["of the"])


COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("vec02_nearest", f"""WITH {VECTORS}, s AS (SELECT b.vec_id, round({COSINE}, 3) AS similarity FROM v a JOIN v b ON a.vec_id = 5 AND b.vec_id <> 5)
    SELECT * FROM s WHERE similarity > 0.2 ORDER BY similarity DESC, vec_id LIMIT 15""")
def vec02(t: Tables) -> DataFrame:
    v = t("embeddings")
    return vectors.nearest(v, v.filter("vec_id = 5"), over=0.2)


@query("vec04_similar_pairs", f"""WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE}, 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.35""")
def vec04(t: Tables) -> DataFrame:
    return vectors.similar_pairs(t("embeddings"), 0.35).withColumn("similarity", F.round("similarity", 6))


@query("vec07_closest_to_centroid", f"""WITH {VECTORS}, p AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2),
    b AS (SELECT label, list(m ORDER BY i) AS e FROM m GROUP BY 1), s AS (SELECT a.label, a.vec_id, round({COSINE}, 6) AS similarity FROM v a JOIN b USING (label))
    SELECT label, vec_id, similarity, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rn FROM s) x WHERE rn <= 3""")
def vec07(t: Tables) -> DataFrame:
    return vectors.closest_to_centroid(t("embeddings"), "label")


@query("vec05_greedy_clusters")
def vec05(t: Tables) -> DataFrame:
    return vectors.greedy_clusters(t("embeddings"), "label", 0.3)


TITLE = "(?is)<title[^>]*>(.*?)</title>"


@query("joi17_similar_titles", f"""WITH w AS (SELECT page_id AS id, list_filter(list_distinct(string_split({NORMAL.format(f"regexp_extract(html, '{TITLE}', 1)")}, ' ')), lambda w: w <> '') AS x FROM pages)
    SELECT a.id AS left_id, b.id AS right_id, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS similarity FROM w a JOIN w b ON a.id < b.id
    WHERE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) > 0.4""")
def joi17(t: Tables) -> DataFrame:
    """The whole title element of every page, wherever it stands and however long it is."""
    sets = t("pages").select(F.col("page_id").alias("id"), X.title_words(F.regexp_extract("html", TITLE, 1)).alias("tokens"))
    return resolve.set_similarity_join(sets, sets, 0.4).filter("left_id < right_id").withColumn("similarity", F.round("similarity", 6))


@query("ent03_match_records", f"""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '10.1000/' || o_orderkey END AS doi, o_orderpriority || ' volume ' || o_custkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 10 < 5),
    c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://doi.org/10.1000/' || (o_orderkey - 5) END AS doi, o_orderpriority || ' volume ' || o_custkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 10 >= 5),
    e AS (SELECT r.id, c.id AS match_id, 1 AS tier FROM r JOIN c ON r.doi = replace(c.doi, 'https://doi.org/', '')),
    k AS (SELECT r.id, c.id AS match_id, CASE WHEN abs(r.year - c.year) <= 1 THEN 2 ELSE 3 END AS tier FROM r JOIN c ON {NORMAL.format('r.title')} = {NORMAL.format('c.title')}),
    b AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM k) u QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, match_id) = 1)
    SELECT r.id, match_id, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'high' WHEN 3 THEN 'fuzzy' ELSE 'none' END AS confidence, CASE WHEN tier IS NOT NULL THEN 1.0::DOUBLE END AS similarity FROM r LEFT JOIN b USING (id)""")
def ent03(t: Tables) -> DataFrame:
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit(" volume "), F.col("o_custkey").cast("string")).alias("title"), F.year("o_orderdate").alias("year"))
    records = orders.filter("id % 10 < 5").withColumn("doi", F.when(F.col("id") % 5 == 0, F.concat(F.lit("10.1000/"), F.col("id").cast("string"))))
    candidates = orders.filter("id % 10 >= 5").withColumn("doi", F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), (F.col("id") - 5).cast("string"))))
    return resolve.match_records(records, candidates)


@query("ded06_exact_title_dedup", "SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)), p_brand ORDER BY p_size DESC, p_partkey) = 1")
def ded06(t: Tables) -> DataFrame:
    return resolve.distinct_by(t("part"), F.struct(F.lower(F.trim("p_name")), "p_brand"), [F.desc("p_size"), F.col("p_partkey")]).select("p_partkey", "p_name")


@query("syn03_curated_merge", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '*' WHEN c_custkey % 6 = 0 THEN c_name ELSE coalesce(c_name, c_name || '*') END AS name,
    CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'REMOTE' END AS segment FROM customer""")
def syn03(t: Tables) -> DataFrame:
    local_marks, remote_marks = F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit("name"))), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("name")))
    name = sync.merge_record(F.col("c_name"), F.concat("c_name", F.lit("*")), "name", sync.PIPELINE, sync.PULL, local_marks, remote_marks)
    segment = sync.merge_record(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 != 0, "REMOTE"), "segment", sync.CURATED, sync.PULL, local_marks, remote_marks)
    return t("customer").select("c_custkey", name.alias("name"), segment.alias("segment"))


@query("snk04_upsert", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN CASE WHEN length(c_mktsegment || ' name') > length(c_name) THEN c_mktsegment || ' name' ELSE c_name END WHEN c_custkey % 2 = 0 THEN c_name
    ELSE c_mktsegment || ' name' END AS name, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN 1.5 END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def snk04(t: Tables) -> DataFrame:
    c = t("customer")
    target = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    updates = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" name")).alias("name"), F.lit(1.5).alias("balance"))
    return sync.upsert(target, updates, "id", {"name": sync.longest("name"), "balance": F.coalesce("old_balance", "new_balance")})


@query("snk05_insert_if_absent", "SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def snk05(t: Tables) -> DataFrame:
    """The existing rows are the nations of suppliers in debt, whatever their ids."""
    have = t("supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))
    return sync.insert_if_absent(have, t("customer").select(F.col("c_nationkey").alias("id")), ["id"])


@query("syn10_changes", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM customer
    WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 = 0)""")
def syn10(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_name")
    old, new = c.filter("id % 7 <> 0"), c.filter("id % 5 <> 0").withColumn("c_name", F.when(F.col("id") % 11 == 0, F.lit("new")).otherwise(F.col("c_name")))
    return sync.changes(old, new, "id", ["c_name"])


@query("ver01_row_counts", """SELECT 'nation' AS "table", (SELECT count(*) FROM nation) AS local, (SELECT count(*) FROM nation) AS remote, true AS agrees
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size < 40), (SELECT count(*) FROM part) = (SELECT count(*) FROM part WHERE p_size < 40)""")
def ver01(t: Tables) -> DataFrame:
    return sync.row_counts({"local": {"nation": t("nation"), "part": t("part")}, "remote": {"nation": t("nation"), "part": t("part").filter("p_size < 40")}})


@query("smp01_stratified")
def smp01(t: Tables) -> DataFrame:
    return sync.stratified(t.items(), "subtype", 200, "item_id")


@query("mth01_similarity_proxies", "SELECT owner_id, round(least(1.0, ln(count(*) + 1) / ln(30.0)), 6) AS by_log, round(least(1.0, 0.5 + 0.15 * count(*)), 6)::DOUBLE AS by_count FROM items GROUP BY 1")
def mth01(t: Tables) -> DataFrame:
    from tarn.operators.related import linear_proxy, log_proxy

    n = F.col("n")
    return t.items().groupBy("owner_id").agg(F.count("*").alias("n")).select("owner_id", F.round(log_proxy(n), 6).alias("by_log"), F.round(linear_proxy(n), 6).alias("by_count"))

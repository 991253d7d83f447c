"""Queries: incremental and curation-safe movement of rows between two sides, limits on events, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import export, resolve, sync
from tarn.plans.registry import query
from tarn.sources import files
from tarn.sources.tables import Tables
from tarn.streaming import limits

SIDES = """l AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, TIMESTAMP '2024-01-01' + (c_custkey % 50) * INTERVAL 1 DAY AS updated_at FROM customer),
    r AS (SELECT c_custkey AS id, TIMESTAMP '2024-01-01' + (c_custkey % 30) * INTERVAL 1 DAY AS updated_at FROM customer WHERE c_custkey % 4 <> 0)"""


def _local(t: Tables) -> DataFrame:
    at = F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(cast(c_custkey % 50 as int))")
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), at.alias("updated_at"))


@query("syn01_newer_wins", f"WITH {SIDES} SELECT l.id, l.updated_at FROM l LEFT JOIN r USING (id) WHERE l.updated_at > TIMESTAMP '2024-01-20' AND (r.updated_at IS NULL OR l.updated_at > r.updated_at)")
def syn01(t: Tables) -> DataFrame:
    remote = t("customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(cast(c_custkey % 30 as int))").alias("updated_at"))
    return sync.newer(_local(t), remote, "id", "updated_at", F.expr("TIMESTAMP '2024-01-20'")).select("id", "updated_at")


@query("syn02_field_rules", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'local' WHEN c_custkey % 3 = 0 THEN 'remote' END AS pipeline, CASE WHEN c_custkey % 3 = 0 THEN 'remote' WHEN c_custkey % 2 = 0 THEN 'local' END AS curated FROM customer""")
def syn02(t: Tables) -> DataFrame:
    """On a pull as on a push: the local side leads pipeline fields, the remote one curated fields, each where it has a value."""
    local, remote = F.when(F.col("c_custkey") % 2 == 0, "local"), F.when(F.col("c_custkey") % 3 == 0, "remote")
    both = lambda kind: [sync.merge_field(local, remote, kind, d) for d in (sync.PULL, sync.PUSH)]
    same = lambda kind: F.when(both(kind)[0].eqNullSafe(both(kind)[1]), both(kind)[0])
    return t("customer").select("c_custkey", same(sync.PIPELINE).alias("pipeline"), same(sync.CURATED).alias("curated"))


@query("syn03_push_union", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'remote' WHEN c_custkey % 6 = 0 THEN 'local' ELSE 'remote' END AS segment,
    array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c_custkey % 6 = 0 THEN ['segment'] ELSE [] END, CASE WHEN c_custkey % 4 = 0 THEN ['segment', 'name'] ELSE [] END))), ',') AS marks FROM customer""")
def syn03_push(t: Tables) -> DataFrame:
    """The push side, and the union of what both sides assert by hand."""
    local, remote = F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit("segment"))), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("segment"), F.lit("name")))
    segment = sync.merge_record(F.lit("local"), F.lit("remote"), "segment", sync.CURATED, sync.PUSH, local, remote)
    return t("customer").select("c_custkey", segment.alias("segment"), F.array_join(sync.united_marks(local, remote), ",").alias("marks"))


@query("syn04_curated_safe", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new' END AS name FROM customer")
def syn04(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("name"))).alias("curated_fields"))
    return rows.select("c_custkey", sync.curated_safe("name", F.lit("new"), F.col("curated_fields")).alias("name"))


@query("syn05_curation_marks", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'name,old' WHEN 1 THEN 'old' WHEN 2 THEN '' ELSE 'name' END AS marks FROM customer""")
def syn05(t: Tables) -> DataFrame:
    """Changed: marked; unchanged: as before; cleared: no longer marked; changed where nothing was marked: marked."""
    k = F.col("c_custkey") % 4
    before = t("customer").select("c_custkey", F.col("c_name").alias("name"))
    had = F.when(k.isin(0, 1), F.array(F.lit("old"))).when(k == 2, F.array(F.lit("name")))
    after = t("customer").select("c_custkey", F.when(k.isin(0, 3), "edited").when(k == 2, " ").otherwise(F.col("c_name")).alias("name"), had.alias("curated_fields"))
    return sync.curation_marks(before, after, "c_custkey", ["name"]).select("c_custkey", F.array_join("curated_fields", ",").alias("marks"))


@query("syn06_value_equality", "SELECT c_custkey, c_custkey % 2 = 0 AS dates, c_custkey % 3 = 0 AS structures, c_custkey % 5 = 0 AS nulls FROM customer")
def syn06(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    at, text = F.expr("TIMESTAMP '2024-01-01 00:00:00'"), F.when(k % 2 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-02")
    left, right = F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b")), F.struct(F.lit(1).alias("a"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("b"))
    none = F.lit(None).cast("string")
    return t("customer").select("c_custkey", sync.same_moment(at, text).alias("dates"), sync.same_value(left, right).alias("structures"), sync.same_value(none, F.when(k % 5 != 0, "v")).alias("nulls"))


@query("syn07_orphans", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
def syn07(t: Tables) -> DataFrame:
    """Only discovered publications that the source no longer has."""
    target = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "discovered").otherwise("curated").alias("origin"), F.when(F.col("o_orderstatus") == "F", "publication").otherwise("document").alias("kind"))
    source = t("orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"))
    return sync.orphans(target, source, "id", (F.col("origin") == "discovered") & (F.col("kind") == "publication")).select("id")


@query("syn08_guarded_replace", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def syn08(t: Tables) -> DataFrame:
    return sync.guarded_replace(t("customer").select("c_custkey"), t("customer").filter("c_custkey % 3 <> 0").select("c_custkey"))


@query("syn09_translated", """SELECT DISTINCT source_item + 1000000 AS source_item, CASE WHEN target_item % 2 = 0 THEN target_item + 1000000 END AS target_item,
    CASE WHEN target_item IS NULL OR target_item % 2 <> 0 THEN 'external' ELSE link_type END AS link_type FROM references_cited""")
def syn09(t: Tables) -> DataFrame:
    ids = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("old_id"), (F.col("o_orderkey") + 1_000_000).alias("new_id"))
    moved = t.references_cited().withColumn("source_item", F.col("source_item") + 1_000_000)
    return sync.translated(moved, ids, "target_item", "link_type")


@query("syn10_keeps_enriched", """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS enriched FROM customer WHERE c_custkey % 5 <> 0""")
def syn10_enriched(t: Tables) -> DataFrame:
    """Rows of the source as they are now, with the fields that were added to them since."""
    c = t("customer")
    old = c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("enriched"))
    new = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 == 0, "new").otherwise(F.col("c_name")).alias("name"))
    return sync.updated(old, new, "id", ["enriched"])


@query("syn11_first_source_wins", "SELECT id, source FROM (SELECT c_custkey AS id, 'a' AS source, 1 AS p FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b', 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'c', 3 FROM customer) u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1")
def syn11(t: Tables) -> DataFrame:
    of = lambda name, wanted: t("customer").filter(wanted).select(F.col("c_custkey").alias("id"), F.lit(name).alias("source"))
    return resolve.coverage_by_priority([of("a", "c_custkey % 2 = 0"), of("b", "c_custkey % 3 = 0"), of("c", "true")], "id")


@query("ver03_citations", "SELECT source_item, CASE WHEN target_item IS NULL THEN 'none' WHEN target_item % 3 = 0 THEN 'invalid' ELSE 'valid' END AS verdict FROM references_cited")
def ver03(t: Tables) -> DataFrame:
    """A citation is valid where the item it names is in the collection."""
    known = t("orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("item_id"))
    return sync.verified(t.references_cited(), known, "target_item", "item_id").select("source_item", "verdict")


@query("snk06_columnar_update", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 ELSE p_size END AS p_size FROM part")
def snk06(t: Tables) -> DataFrame:
    """Parallel arrays of ids and values are zipped to rows, which update the table."""
    arrays = t("part").filter("p_partkey % 3 = 0").groupBy((F.col("p_partkey") % 50).alias("batch")).agg(F.collect_list(F.struct("p_partkey", (F.col("p_size") * 2).alias("v"))).alias("z"))
    rows = sync.zipped_rows(arrays.select(F.col("z.p_partkey").alias("ids"), F.col("z.v").alias("values")), {"ids": "p_partkey", "values": "p_size"})
    return sync.upsert(t("part").select("p_partkey", "p_size"), rows, "p_partkey", {}).select("p_partkey", "p_size")


@query("snk09_csv_worklist", r"""SELECT item_id, item_id || ',' || '"' || title || ', "' || '"' || subtype || '""' || '"' || ',' || CASE WHEN year > 1995 THEN CAST(year AS VARCHAR) ELSE '' END AS line FROM items""")
def snk09(t: Tables) -> DataFrame:
    rows = t.items().select("item_id", F.concat(F.col("title"), F.lit(', "'), F.col("subtype"), F.lit('"')).alias("label"), F.when(F.col("year") > 1995, F.col("year")).alias("year"))
    return rows.select("item_id", files.csv_line("item_id", "label", "year").alias("line"))


CITED = """c AS (SELECT item_id, title || ' of {50%}' AS title, year, CASE collection WHEN 'F' THEN 'article' WHEN 'O' THEN 'thesis' ELSE 'other' END AS kind, owner_id FROM items)"""


def _cited(t: Tables) -> DataFrame:
    kind = F.when(F.col("collection") == "F", "article").when(F.col("collection") == "O", "thesis").otherwise("other")
    people = F.array(F.concat(F.lit("O'Day, N"), F.col("owner_id").cast("string")), F.lit("Ana Müller"))
    none = F.lit(None).cast("string")
    return t.items().select(
        F.col("item_id").alias("id"), F.concat("title", F.lit(" of {50%}")).alias("title"), "year", kind.alias("kind"), people.alias("authors"), F.lit("Annals\n of Work").alias("journal"), none.alias("volume"),
        F.lit("7").alias("issue"), F.lit("10–12").alias("pages"), none.alias("doi"), F.lit("").alias("abstract"), F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("path"), F.array(F.lit("a b")).alias("keywords"),
    )


@query("snk10_ris", f"""WITH {CITED} SELECT item_id AS id, concat('TY  - ', CASE kind WHEN 'article' THEN 'JOUR' WHEN 'thesis' THEN 'THES' ELSE 'GEN' END, e, 'TI  - ', title, e, 'AU  - O''Day, N', owner_id, e, 'AU  - Ana Müller', e, 'PY  - ', year, e,
    'JO  - Annals of Work', e, 'IS  - 7', e, 'SP  - 10', e, 'EP  - 12', e, 'UR  - https://example.org/items/', item_id, e, 'KW  - a b', e, 'DB  - Knowledge collections', e, 'ER  - ', e) AS ris FROM c, (SELECT chr(13) || chr(10) AS e) x""")
def snk10_ris(t: Tables) -> DataFrame:
    return _cited(t).select("id", export.to_ris().alias("ris"))


@query("snk10_bibtex", f"""WITH {CITED} SELECT item_id AS id, concat('@', CASE kind WHEN 'article' THEN 'article' WHEN 'thesis' THEN 'phdthesis' ELSE 'misc' END, '{{oday', year, CASE WHEN w = '' THEN 'untitled' ELSE w END, ',', e,
    '  author = {{O''Day, N', owner_id, ' and Ana Müller}},', e, '  title = {{', replace(replace(replace(title, '{{', '\\{{'), '}}', '\\}}'), '%', '\\%'), '}},', e, '  year = {{', year, '}},', e, '  journal = {{Annals', e, ' of Work}},', e, '  number = {{7}},', e,
    '  pages = {{10--12}},', e, '  url = {{https://example.org/items/', item_id, '}}', e, '}}', e) AS bibtex FROM (SELECT *, regexp_replace(lower(split_part(title, ' ', 1)), '[^a-z]', '', 'g') AS w FROM c) y, (SELECT chr(10) AS e) x""".replace("{{", "{").replace("}}", "}"))
def snk10_bibtex(t: Tables) -> DataFrame:
    return _cited(t).select("id", export.to_bibtex().alias("bibtex"))


@query("snk10_csl", f"""WITH {CITED} SELECT item_id AS id, concat('{{"id":"publication-', item_id, '","type":"', CASE kind WHEN 'article' THEN 'article-journal' WHEN 'thesis' THEN 'thesis' ELSE 'article' END, '","title":"', title,
    '","author":[{{"family":"O''Day","given":"N', owner_id, '"}},{{"family":"Müller","given":"Ana"}}],"issued":{{"date-parts":[[', year, ']]}},"container-title":"Annals\\n of Work","issue":"7","page":"10-12","URL":"https://example.org/items/', item_id, '","source":"Knowledge collections"}}') AS csl FROM c""".replace("{{", "{").replace("}}", "}"))
def snk10_csl(t: Tables) -> DataFrame:
    return _cited(t).select("id", export.to_csl().alias("csl"))


@query("snk11_result_lines", "SELECT item_id, CAST(n AS VARCHAR) || '. ' || title || ' [' || subtype || CASE WHEN year > 1995 THEN ', ' || year ELSE '' END || ']' AS line FROM (SELECT *, row_number() OVER (ORDER BY cites DESC, item_id) AS n FROM items) x WHERE n <= 50")
def snk11(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    head = t.items().orderBy(F.desc("cites"), "item_id").limit(50)
    n = F.row_number().over(W.orderBy(F.desc("cites"), "item_id"))  # 50 rows
    return head.select("item_id", export.result_line(n, F.col("title"), F.col("subtype"), F.when(F.col("year") > 1995, F.col("year"))).alias("line"))


@query("snk13_report", """WITH g AS (SELECT subtype, CAST(avg(cites) AS DOUBLE) AS score, string_agg(DISTINCT collection, ', ' ORDER BY collection) AS m FROM items GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, subtype) AS k FROM g)
    SELECT 0 AS n, '# Clusters' AS line UNION ALL SELECT 2 * k - 1, '## ' || k || '. ' || subtype FROM r WHERE k <= 3 UNION ALL SELECT 2 * k, 'Score ' || printf('%.2f', score) || ': ' || m FROM r WHERE k <= 3""")
def snk13(t: Tables) -> DataFrame:
    groups = t.items().groupBy("subtype").agg(F.avg("cites").alias("score"), F.array_sort(F.collect_set("collection")).alias("members"))
    return export.report(groups, "Clusters", "subtype", "score", "members", 3)


@query("snk17_sitemap", """SELECT 'https://example.org/items/' || o_orderkey AS url, CAST(o_orderdate AS DATE) AS updated_at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'https://example.org/authors/' || s_suppkey, NULL FROM supplier""")
def snk17(t: Tables) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return export.sitemap({"items": (t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey", F.col("o_orderdate")), "authors": (t("supplier"), "s_suppkey", none)})


@query("src13_listing", """SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1 FROM pages WHERE regexp_extract(html, '(?is)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>', 1) <> ''""")
def src13(t: Tables) -> DataFrame:
    found = t("pages").select("page_id", F.inline(files.listing(F.col("html"))))
    return found.filter("title is not null").select("page_id", F.col("title").alias("h1"))


@query("src14_numbered_articles", """SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS number, p_name AS title, p_type || ' body' AS body FROM part""")
def src14(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    entries = t("part").select("p_brand", n.alias("n"), F.concat(n.cast("string"), F.lit(". "), F.col("p_name"), F.lit("\n"), F.col("p_type"), F.lit(" body\n")).alias("e"))
    dumps = entries.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda s: s["e"]), "").alias("dump"))
    return dumps.select("p_brand", F.inline(files.numbered_articles(F.concat(F.lit("Preface 12\n"), F.col("dump")))))


@query("src19_nested_columns", "SELECT * FROM (VALUES ('embeddings', 'embedding')) v(\"table\", \"column\")")
def src19(t: Tables) -> DataFrame:
    rows = [(name, c) for name in ("documents", "embeddings", "pages") for c in t.jsonb_columns(name)]
    return t.spark.createDataFrame(rows, "table string, column string")


@query("stm01_sliding_limit", """SELECT event_id, used, used <= CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS allowed FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS used FROM events) x""")
def stm01(t: Tables) -> DataFrame:
    """Dear events are allowed less often; the window is an hour, since the table has few events a minute."""
    most = F.when(F.col("event_type") == "error", 1).otherwise(2)
    return limits.limited(t("events"), "user_id", "ts", most, 3600).select("event_id", "used", "allowed")


@query("stm02_flags_an_hour", """SELECT user_id, count(*) FILTER (used > 2) AS refused FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS used FROM events) x GROUP BY 1""")
def stm02(t: Tables) -> DataFrame:
    judged = limits.limited(t("events"), "user_id", "ts", F.lit(2), 3600)
    return judged.groupBy("user_id").agg(F.count_if(~F.col("allowed")).alias("refused"))


@query("stm03_no_duplicates_in_a_day", """SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) x WHERE before IS NULL OR ts - before > INTERVAL 24 HOUR""")
def stm03(t: Tables) -> DataFrame:
    return limits.first_within(t("events"), ["user_id", "event_type"], "ts", 24, "event_id").select("event_id")


@query("stm04_high_water_mark", "SELECT event_id, (SELECT max(ts) FROM events) AS mark FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def stm04(t: Tables) -> DataFrame:
    import datetime

    changed, mark = limits.high_water(t("events"), "ts", datetime.datetime(2024, 1, 10))
    return changed.select("event_id", F.lit(mark).cast("timestamp").alias("mark"))

"""Queries: references, authors, entities and stories matched to collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import matching
from tarn.plans.registry import query
from tarn.sources.tables import Tables

STUDY = "concat('a study of ', p_name, ' and ', p_type, ' number ', p_partkey)"


def _publications(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.expr("if(p_partkey % 2 = 0, concat('10.1/p', p_partkey), null)").alias("doi"), F.expr(STUDY).alias("title"), (F.col("p_size") + 1950).alias("year"))


@query("ent01_reference_cascade", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'dataset' WHEN c_custkey % 5 <> 4 THEN 'publication' END AS collection,
    CASE c_custkey % 5 WHEN 0 THEN c_custkey % 200 - (c_custkey % 200) % 2 WHEN 1 THEN c_custkey % 10 WHEN 4 THEN NULL ELSE c_custkey % 200 END AS target,
    CASE WHEN c_custkey % 5 IN (0, 1) THEN 'doi' WHEN c_custkey % 5 IN (2, 3) THEN 'title' END AS method, CASE WHEN c_custkey % 5 <> 4 THEN 1.0::DOUBLE END AS confidence,
    CASE WHEN c_custkey % 5 = 4 THEN 'external' ELSE 'internal' END AS link_type FROM customer""")
def ent01(t: Tables) -> DataFrame:
    case = F.col("c_custkey") % 5
    cited = t("customer").withColumn("p_partkey", F.col("c_custkey") % 200).join(t("part").filter("p_partkey < 200").select("p_partkey", F.expr(STUDY).alias("study")), "p_partkey", "left")
    doi = F.when(case == 0, F.expr("concat('https://doi.org/10.1/P', p_partkey - p_partkey % 2)")).when(case == 1, F.expr("concat('10.2/d', c_custkey % 10)"))
    title = F.when(case == 2, F.upper("study")).when(case == 4, F.expr("concat('entirely other words here ', c_custkey)"))
    refs = cited.select(F.col("c_custkey").alias("id"), doi.alias("doi"), title.alias("title"), F.when(case == 3, F.expr("concat('Smith, J. 1999. ', study, '. Journal of it, 7')")).alias("raw"))
    datasets = t("supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('10.2/D', s_suppkey)").alias("doi"))
    return matching.match_references(refs, _publications(t), datasets).select("id", "collection", "target", "method", "confidence", "link_type")


@query("ent02_by_trigrams", f"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'publication' WHEN 1 THEN 'dataset' END AS collection, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_partkey END AS target, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 1.0::DOUBLE END AS confidence FROM part""")
def ent02(t: Tables) -> DataFrame:
    """The first collection that has the title; a third of the references is only to itself and stays unmatched."""
    title = F.expr("concat(left(sha2(cast(p_partkey as string), 256), 8), ' ', left(sha2(cast(-p_partkey as string), 256), 8), ' is a title')")
    rows = t("part").select(F.col("p_partkey").alias("id"), title.alias("title"), F.col("p_size").alias("year"), (F.col("p_partkey") % 3).alias("k"))
    own = F.struct(F.lit("document").alias("collection"), F.col("id"))
    refs = rows.select("id", F.upper("title").alias("title"), "year", own.alias("own"))
    stages = [("publication", rows.filter("k = 0")), ("dataset", rows.filter("k = 1")), ("document", rows.filter("k = 2"))]
    found = matching.match_by_trigrams(refs, [(n, df.select("id", "title", "year")) for n, df in stages])
    return refs.select("id").join(found, "id", "left")


@query("ent04_author_dedup", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey // 8 * 8 + 3 ELSE s_suppkey - s_suppkey % 4 END AS canonical_id,
    'Fam' || CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey // 8 * 2 ELSE s_suppkey // 4 END AS family, CASE WHEN s_suppkey % 4 = 3 THEN 'Maria' ELSE 'John A.' END AS given, CASE WHEN s_suppkey % 4 = 3 THEN 'o' || (s_suppkey // 8) END AS orcid FROM supplier""")
def ent04(t: Tables) -> DataFrame:
    """Of each family John A., J. A. and J. are one; Maria has an ORCID, by which two families are one author."""
    k = F.col("s_suppkey")
    given = F.element_at(F.array(*(F.lit(g) for g in ("John A.", "J. A.", "J.", "Maria"))), (k % 4 + 1).cast("int"))
    authors = t("supplier").select(k.alias("id"), F.expr("concat('Fam', s_suppkey div 4)").alias("family"), given.alias("given"), F.expr("if(s_suppkey % 4 = 3, concat('o', s_suppkey div 8), null)").alias("orcid"))
    return matching.dedupe_authors(authors)


@query("ent08_author_links", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey END AS author_id, CASE s_suppkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'initial' ELSE 'new' END AS how FROM supplier""")
def ent08(t: Tables) -> DataFrame:
    """Full names; initials of one author; initials that two authors share; names that nobody has."""
    k = F.col("s_suppkey")
    letters = F.expr("concat(chr(cast(97 + s_suppkey % 26 as int)), chr(cast(97 + s_suppkey div 26 % 26 as int)), 'x')")
    family = F.concat(F.lit("Fam"), k.cast("string"))
    authors = t("supplier").select(k.alias("author_id"), letters.alias("given"), family.alias("family"))
    twins = t("supplier").filter("s_suppkey % 4 = 2").select((k + 1_000_000).alias("author_id"), F.concat(letters, F.lit("y")).alias("given"), family.alias("family"))
    asked = F.when(k % 4 == 0, F.upper(letters)).when(k % 4 == 3, "Zed").otherwise(F.concat(F.left(letters, F.lit(1)), F.lit(".")))
    found = t("supplier").select(k.alias("id"), asked.alias("given"), F.when(k % 4 == 3, "Nobody").otherwise(family).alias("family"))
    return matching.link_authors(found, authors.unionByName(twins))


@query("ent14_plural_merge", """WITH e AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END || '-' || p_brand AS raw FROM part),
    n AS (SELECT id, lower(split_part(raw, '-', 1)) AS name FROM e), s AS (SELECT name, min(id) AS least FROM n GROUP BY 1)
    SELECT n.id AS old_id, s.least AS new_id FROM n JOIN s ON n.name = s.name || 's' WHERE length(n.name) >= 5""")
def ent14(t: Tables) -> DataFrame:
    name = F.expr("concat(split_part(p_name, ' ', 2), if(p_partkey % 2 = 0, 's', ''))")
    entities = t("part").select(F.col("p_partkey").alias("entity_id"), name.alias("name"))
    mentions = t("lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("item_id"))
    return matching.merge_plurals(entities, mentions)[0]


@query("ent14_repointed_mentions", """WITH n AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 2)) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS name FROM part), s AS (SELECT name, min(id) AS least FROM n GROUP BY 1),
    m AS (SELECT n.id AS old_id, s.least AS new_id FROM n JOIN s ON n.name = s.name || 's' WHERE length(n.name) >= 5)
    SELECT DISTINCT coalesce(new_id, l_partkey) AS entity_id, l_orderkey AS item_id FROM lineitem LEFT JOIN m ON old_id = l_partkey""")
def ent14_mentions(t: Tables) -> DataFrame:
    name = F.expr("concat(split_part(p_name, ' ', 2), if(p_partkey % 2 = 0, 's', ''))")
    entities = t("part").select(F.col("p_partkey").alias("entity_id"), name.alias("name"))
    mentions = t("lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("item_id"))
    return matching.merge_plurals(entities, mentions)[1]


@query("ent16_backfilled_mentions", """WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS line FROM documents)
    SELECT e AS entity_id, doc_id AS item_id, 0.5::DOUBLE AS confidence FROM d, (SELECT unnest([1, 2, 3]) AS e, unnest(['of the', 'and', 'in the thing']) AS p) x WHERE contains(line, ' ' || p || ' ') AND NOT (e = 1 AND doc_id % 2 = 0)""")
def ent16(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(1, "Of the"), (2, "and"), (3, "in the thing"), (4, " ")], "entity_id int, phrase string")
    have = t("documents").filter("doc_id % 2 = 0").select(F.lit(1).alias("entity_id"), F.col("doc_id").alias("item_id"))
    return matching.backfilled_mentions(t("documents"), terms, have)


@query("ent18_merged_extractions", """SELECT l_orderkey AS doc, lower(l_returnflag) AS name, l_linenumber AS chunk FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(l_returnflag) ORDER BY (l_quantity > 25)::INT + (l_discount > 0.05)::INT DESC, l_linenumber * 1000000 + l_partkey) = 1""")
def ent18(t: Tables) -> DataFrame:
    """The chunk with most fields, then the first; equal rows of a line number are told apart by the part."""
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("name"), F.col("l_linenumber").alias("chunk"),
        F.when(F.col("l_quantity") > 25, "x").alias("a"), F.when(F.col("l_discount") > 0.05, "y").otherwise("").alias("b"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("at"),
    )
    return matching.merge_extractions(rows, "doc", "name", "at", ["a", "b"]).select("doc", F.lower(F.trim("name")).alias("name"), "chunk")


@query("ent20_resolved_names", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'author' WHEN 1 THEN 'place' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey % 25 END AS target FROM supplier""")
def ent20(t: Tables) -> DataFrame:
    name = F.expr("CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat(' nation_', s_suppkey % 25, ' ') ELSE 'nothing' END")
    maps = [("author", t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))), ("place", t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))]
    return matching.resolved_names(t("supplier").select("s_suppkey", name.alias("name")), "name", maps).select("s_suppkey", "kind", "target")


@query("joi20_lookup_by_key", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 200 END AS id FROM customer")
def joi20(t: Tables) -> DataFrame:
    """Lower-case natural keys; the last of equal keys would win, here they are distinct."""
    index = t("part").filter("p_partkey < 200").groupBy(F.lower(F.expr(STUDY)).alias("k")).agg(F.max("p_partkey").alias("id"))
    asked = t("customer").select("c_custkey", (F.col("c_custkey") % 200).alias("p_partkey")).join(t("part").select("p_partkey", F.expr(STUDY).alias("s")), "p_partkey", "left")
    keyed = asked.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower(F.upper("s"))).alias("k"))
    return keyed.join(index, "k", "left").select("c_custkey", "id")


CANDIDATES = """SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer"""


def _candidates(t: Tables) -> DataFrame:
    """By id modulo 4: the DOI of a publication; its title in capitals; its title with one word more; neither."""
    cited = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("k"), (F.col("c_custkey") % 200).alias("p_partkey"))
    joined = cited.join(t("part").filter("p_partkey < 200").select("p_partkey", "p_size", F.expr(STUDY).alias("study")), "p_partkey", "left")
    doi = F.when(F.col("k") == 0, F.expr("concat('10.1/P', p_partkey - p_partkey % 2)"))
    title = F.expr("CASE k WHEN 0 THEN concat('no such title ', id) WHEN 1 THEN upper(study) WHEN 2 THEN concat(study, ' again') ELSE concat('some other thing ', id) END")
    return joined.select("id", doi.alias("doi"), title.alias("title"), (F.col("p_size") + 1950 + F.col("p_partkey") % 5).alias("year"))


@query("ded01_duplicates", f"SELECT id, k <> 3 AS duplicate FROM ({CANDIDATES}) c")
def ded01(t: Tables) -> DataFrame:
    return matching.duplicates(_candidates(t), _publications(t), 0.8).select("id", "duplicate")


@query("ded02_duplicates_by_year", f"SELECT id, k = 0 OR (k IN (1, 2) AND id % 200 % 5 <= 2) AS duplicate FROM ({CANDIDATES}) c")
def ded02(t: Tables) -> DataFrame:
    """Titles count with years at most two apart."""
    return matching.duplicates(_candidates(t), _publications(t), 0.85, 2).select("id", "duplicate")


@query("ded02_new_records", f"SELECT id FROM ({CANDIDATES}) c WHERE NOT (k = 0 OR (k IN (1, 2) AND id % 200 % 5 <= 2))")
def ded02_new(t: Tables) -> DataFrame:
    from tarn.operators import resolve

    return resolve.new_records(_candidates(t), _publications(t)).select("id")


@query("ded03_loaded", f"SELECT id FROM ({CANDIDATES}) c WHERE NOT (k = 0 OR (k = 1 AND id % 200 % 5 <= 1))")
def ded03(t: Tables) -> DataFrame:
    return matching.loaded(_candidates(t), _publications(t)).select("id")


@query("ded04_tombstones", f"SELECT id, CASE WHEN k = 0 THEN 'doi' WHEN id % 7 = 0 THEN 'url' WHEN k = 1 AND id % 200 % 5 <= 1 THEN 'title' END AS stone FROM ({CANDIDATES}) c")
def ded04(t: Tables) -> DataFrame:
    rows = _candidates(t).withColumn("url", F.expr("if(id % 7 = 0, 'HTTP://gone.example/', concat('http://a.example/', id))"))
    stones = _publications(t).filter("id < 200").withColumn("url", F.lit("http://gone.example"))
    return matching.tombstoned(rows, stones).select("id", "stone")


@query("ded05_story_upsert", """SELECT id, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(text) DESC, new, id) AS rn FROM (
    SELECT doc_id AS id, coalesce(text, '') AS text, 0 AS new, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 't' || (doc_id // 10) END AS k FROM documents
    UNION ALL SELECT doc_id + 10000000, left(coalesce(text, ''), 100) || repeat('x', CAST(doc_id % 3 AS INTEGER) * 1000), 1, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 't' || (doc_id // 10) END FROM documents) u) v WHERE rn = 1""")
def ded05(t: Tables) -> DataFrame:
    """Stories with an address are one by it, those without by their title."""
    url, title = F.expr("if(doc_id % 2 = 0, concat('http://s.example/', doc_id), ' ')"), F.expr("concat('<b>Story</b>  ', doc_id div 10)")
    old = t("documents").select(F.col("doc_id").alias("id"), url.alias("url"), title.alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    longer = F.expr("concat(left(coalesce(text, ''), 100), repeat('x', cast(doc_id % 3 as int) * 1000))")
    new = t("documents").select((F.col("doc_id") + 10_000_000).alias("id"), url.alias("url"), F.upper(title).alias("title"), longer.alias("text"))
    return matching.upsert_stories(old, new).select("id", F.length("text").cast("long").alias("size"))


@query("ded06_story_passes", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'excluded' WHEN p_partkey % 7 = 1 AND p_partkey >= 7 THEN 'copy' WHEN p_partkey % 7 = 3 THEN 'near' WHEN p_partkey % 7 = 4 THEN 'irrelevant' END AS reason FROM part""")
def ded06_passes(t: Tables) -> DataFrame:
    """By id modulo 7: letters to the editor; one title for all; a title and the same with one word more; stories of other things."""
    k = F.col("p_partkey") % 7
    long = F.expr("concat('alpha beta gamma delta epsilon zeta eta theta ', sha2(cast(p_partkey as string), 256))")
    pair = F.expr("concat('one two three four five six seven eight ', sha2(cast(if(p_partkey % 7 = 3, p_partkey - 1, p_partkey) as string), 256))")
    title = F.when(k == 0, "Letters to the editor").when(k == 1, "One and the same").when(k == 2, pair).when(k == 3, F.concat(pair, F.lit(" more"))).when(k == 4, F.lower(long)).otherwise(F.concat(F.lit("Meadow "), long))
    text = F.when(k == 4, "nothing of note").when(k == 2, "a longer text about a meadow").otherwise("on a meadow")
    stories = t("part").select(F.col("p_partkey").alias("id"), title.alias("title"), text.alias("text"))
    return matching.story_passes(stories, ["Obituary"], ["letters to%"], 0.85, ["meadow", "river"]).select("id", "reason")

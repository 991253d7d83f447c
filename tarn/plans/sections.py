"""Queries: parts of longer texts and what they are about, held against what the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import sections as S
from tarn.operators import browse
from tarn.plans.parsing import FIRST, SECOND, A, B
from tarn.plans.registry import query
from tarn.sources.tables import Tables


@query("str05_dataset_links", "SELECT p_partkey, '10.5061/dryad.' || p_partkey || '|10.5281/zenodo.' || p_partkey || '|https://figshare.com/x' || p_partkey AS links FROM part")
def str05(t: Tables) -> DataFrame:
    made = F.expr("concat('Data (doi:10.5061/dryad.', p_partkey, '). See https://zenodo.org/doi/10.5281/zenodo.', p_partkey, ', https://figshare.com/x', p_partkey, ' and 10.1000/paper', p_partkey, '; again 10.5061/dryad.', p_partkey, '.')")
    links = S.dataset_links(made, ["5061", "6073"], ["zenodo.org", "figshare.com"])
    return t("part").select("p_partkey", F.array_join(links, "|").alias("links"))


@query("str06_clean_dois", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN '10.1234/abcde' || p_partkey END AS doi FROM part")
def str06(t: Tables) -> DataFrame:
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('10.1234/ab', '\\u200B', 'cde', p_partkey, '.)') WHEN 1 THEN concat('10.1234/abcde', p_partkey) WHEN 2 THEN '10.5061/dryad' ELSE '10.1234/ab' END")
    return t("part").select("p_partkey", S.clean_doi(raw).alias("doi"))


@query("str13_mentors", f"SELECT p_partkey, concat({FIRST}, ' ', {A}. ', {SECOND}, '|', {SECOND}, ' ', {FIRST}) AS people FROM part".replace(f"{A}. '", f"{A}, '. '"))
def str13(t: Tables) -> DataFrame:
    raw = F.expr(f"concat('Dr. ', {FIRST}, ' ', {A}, '. ', {SECOND}, ', Ph.D.2 (Some Place) and ', {SECOND}, ' ', {FIRST}, ' University of it, The Other\nnext line Person')")
    return t("part").select("p_partkey", F.array_join(S.people(raw), "|").alias("people"))


@query("str17_species_names", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower({FIRST}) || 's' WHEN 1 THEN lower({FIRST}) || ' ' || lower({SECOND}) || 's' WHEN 2 THEN 'yellow ' || lower({SECOND}) ELSE 'ants' END AS name FROM part")
def str17(t: Tables) -> DataFrame:
    raw = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN concat(' ', {FIRST}, 's ') WHEN 1 THEN concat({FIRST}, ' ', lower({SECOND}), 's') WHEN 2 THEN concat('yellow ', lower({SECOND}), 's') ELSE 'ants' END")
    return t("part").select("p_partkey", S.grouping_name(raw).alias("name"))


@query("str19_stakeholders", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'us forest service' WHEN 1 THEN lower({FIRST}) || ' county' WHEN 2 THEN lower({FIRST}) || ' llc' ELSE 'environmental protection agency' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'federal_agency' WHEN 1 THEN 'local_gov' WHEN 2 THEN 'industry' ELSE 'federal_agency' END AS kind FROM part")
def str19(t: Tables) -> DataFrame:
    raw = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN 'The U.S. Forest Service (USFS)' WHEN 1 THEN concat(' \"', {FIRST}, '\"  County.') WHEN 2 THEN concat({FIRST}, ' LLC;') ELSE 'E.P.A.' END")
    name = S.agency_name(raw, {"e p a": "environmental protection agency"})
    return t("part").select("p_partkey", name.alias("name"), S.agency_kind(name).alias("kind"))


@query("str22_topics", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_name LIKE '%ring%' THEN 'rings' END, CASE WHEN p_type LIKE 'S%' THEN 's' END, CASE WHEN p_name LIKE '%l%' THEN 'l' END], lambda x: x IS NOT NULL), ',') AS topics FROM part")
def str22(t: Tables) -> DataFrame:
    made = S.topics(F.concat_ws(" | ", "p_type", "p_name"), [(r"\bring\b|ring", "rings"), ("^s", "s"), (r"\|.*l", "l")])
    return t("part").select("p_partkey", F.array_join(made, ",").alias("topics"))


@query("str25_abstracts", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE trim(regexp_replace('Begin ' || doc_id || ' ' || repeat('of an abstract line ', 5), '\\s+', ' ', 'g')) END AS abstract FROM documents""")
def str25(t: Tables) -> DataFrame:
    body = "concat('Begin ', doc_id, '\n', repeat('of an abstract  line ', 5))"
    made = F.expr(f"concat('A TITLE\n\n', CASE doc_id % 3 WHEN 0 THEN 'abstract of nothing' WHEN 1 THEN concat('Abstract:\n', {body}, '\nKeywords: x') ELSE concat('ABSTRACT\n\n', {body}, '\n\nMore') END)")
    return t("documents").select("doc_id", S.abstract(made).alias("abstract"))


@query("str25_summaries", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(repeat('the body of it says this here ' || doc_id || ' ', 3)) || ' and so on' END AS summary FROM documents")
def str25_summary(t: Tables) -> DataFrame:
    """Title lines are passed over; a text of headers alone has no summary."""
    made = F.expr("if(doc_id % 2 = 0, concat('A TITLE OF MANY CAPITALS THAT IS LONGER THAN FIFTY CHARACTERS\n short line\n', repeat(concat('the body of it says this here ', doc_id, ' '), 3), '\n and so on'), 'ONLY\nheaders')")
    return t("documents").select("doc_id", S.summary(made).alias("summary"))


@query("str27_references", f"""SELECT p_partkey, 0 AS pos, concat({FIRST}, ', ', {A}, '. and ', {SECOND}, ', ', {B}, '.') AS authors, 1950 + p_size AS year, concat('On the ', p_name, ' and its kin') AS title, concat('10.1234/ab', p_partkey) AS doi FROM part
    UNION ALL SELECT p_partkey, 1, concat({SECOND}, ', ', {A}), 2001, concat('Another title of it ', p_partkey), NULL FROM part""")
def str27(t: Tables) -> DataFrame:
    """Two references over three lines each, behind a header and before an appendix."""
    made = F.expr(f"""concat('Text of 1999. References in general\n References \n1. ', {FIRST}, ', ', {A}, '. and ', {SECOND}, ', ', {B}, '. (', 1950 + p_size, '). On the ', p_name, '\n and its kin. Journal of it 7:\n 1-9. doi:10.1234/ab', p_partkey, '.\n\n[2] ', {SECOND}, ', ', {A}, '.
        2001a. Another title of it ', p_partkey, '. Annals\nAppendix\nSmith, J. 1999. Not a reference of this list at all. X')""")
    found = F.posexplode(F.transform(S.split_references(S.reference_section(made)), S.parse_reference)).alias("pos", "r")
    return t("part").select("p_partkey", found).select("p_partkey", "pos", "r.authors", "r.year", "r.title", "r.doi")


@query("str34_sections", "SELECT p_partkey, p_name || ' in words' AS gap, p_type AS need FROM part")
def str34(t: Tables) -> DataFrame:
    made = F.expr("concat('# Top\n## Gap\n[', p_name, '](http://x.example/a) in words\n\n## Other\nno\n## Need\n', p_type)")
    found = S.headed_sections(made, ["Gap", "Need", "Missing"])
    return t("part").select("p_partkey", F.try_element_at(found, F.lit("Gap")).alias("gap"), F.try_element_at(found, F.lit("Need")).alias("need"))


@query("str36_search_terms", f"SELECT p_partkey, {FIRST} || ' ' || lower({SECOND}) || '|brown ' || lower({SECOND}) || ' x|Marmota' AS terms FROM part")
def str36(t: Tables) -> DataFrame:
    """Binomials, long phrases, capitalised genus names; not single common words, short phrases or short names."""
    made = S.search_terms(F.expr(f"concat({FIRST}, ' ', lower({SECOND}))"), F.expr(f"array('Beaver', concat('brown ', lower({SECOND}), ' x'), 'a b', null)"), F.array(F.lit("Marmota"), F.lit("Abies"), F.lit(" ")))
    return t("part").select("p_partkey", F.array_join(made, "|").alias("terms"))


@query("str37_paragraph_chunks")
def str37_paragraphs(t: Tables) -> DataFrame:
    chunks = S.paragraph_chunks(1000, 100)
    return t("documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("k", "chunk"))


@query("str38_divided", "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 4 END AS INTEGER) AS n, CASE doc_id % 3 WHEN 0 THEN 'Chapter 2 two' WHEN 1 THEN '2. Two' ELSE 'bbbb' END AS second FROM documents")
def str38(t: Tables) -> DataFrame:
    made = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Preface\nchapter 1 one\nChapter 2 two\n' WHEN 1 THEN 'x\n2. Two\n3. Three\n4. Four' ELSE 'aaaabbbbccccdd' END")
    parts = S.divided(made)
    return t("documents").select("doc_id", F.size(parts).alias("n"), F.trim(F.regexp_replace(F.when(F.col("doc_id") % 3 == 0, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), "\n", "")).alias("second"))


RULES = ("'the gothic horror of it'", "'meadow station work'", "'a valley of colorado'", "'a valley elsewhere'", "'meadow station and vampire'")


@query("flt13_relevance", "SELECT p_partkey, p_partkey % 6 IN (1, 2) AS relevant, p_partkey % 6 IN (0, 5) AS off_target FROM part")
def flt13(t: Tables) -> DataFrame:
    """FLT-13 and FLT-14: by part modulo 6 an excluded text, a strong one, a weak one in context, a weak one without, a strong one with
    an excluded word, and a rejected journal."""
    text = F.expr(f"CASE p_partkey % 6 WHEN 0 THEN {RULES[0]} WHEN 1 THEN {RULES[1]} WHEN 2 THEN {RULES[2]} WHEN 3 THEN {RULES[3]} WHEN 4 THEN {RULES[4]} ELSE {RULES[2]} END")
    journal = F.expr("if(p_partkey % 6 = 5, 'Horror Studies Quarterly', 'Annals')")
    relevant = S.relevant(text, journal, ["Horror Studies"], "gothic|vampire", "meadow station", r"\bvalley\b", "colorado")
    return t("part").select("p_partkey", relevant.alias("relevant"), S.off_target(text, journal, ["Horror Studies"], "gothic|vampire", "meadow station").alias("off_target"))


@query("ent06_false_merges", """SELECT s_suppkey AS author_id, CASE WHEN s_suppkey % 2 = 0 THEN 'JA,JB' ELSE 'JA' END AS signatures, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM supplier""")
def ent06(t: Tables) -> DataFrame:
    """Works whose given names have other initials than the rest are signs that an author is two."""
    from tarn.functions import names

    works = t("supplier").select(F.col("s_suppkey").alias("author_id"), F.explode(F.array(F.lit("John A."), F.lit("J. A."), F.when(F.col("s_suppkey") % 2 == 0, "J. B.").otherwise("John Albert"))).alias("given"))
    signed = works.select("author_id", names.signature(F.col("given")).alias("s")).groupBy("author_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return signed.select("author_id", F.array_join("s", ",").alias("signatures"), F.size("s").cast("long").alias("n"))


@query("rst01_taxonomy", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Legacy' WHEN p_name LIKE '%ring%' THEN 'Rings' WHEN p_name LIKE '%bolt%' THEN 'Bolts' ELSE 'Other' END AS parent FROM part")
def rst01(t: Tables) -> DataFrame:
    """A topic named in the map goes to its parent there, else to the first category that fits, else to Other."""
    from tarn.functions.text import first_rule

    legacy = F.when(F.col("p_partkey") % 5 == 0, "Legacy")
    return t("part").select("p_partkey", F.coalesce(legacy, first_rule(F.col("p_name"), (("ring", "Rings"), ("bolt", "Bolts")), "Other")).alias("parent"))


@query("rst03_added_topics", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'old,rings' ELSE 'old' END AS topics FROM part WHERE p_name LIKE '%ring%' AND p_partkey % 2 = 0 OR p_name LIKE '%ring%' AND p_partkey % 2 = 1 AND p_type LIKE 'S%'")
def rst03(t: Tables) -> DataFrame:
    """New topics join those an item has; only items that gained one are written."""
    had = F.when((F.col("p_partkey") % 2 == 1) & ~F.col("p_type").startswith("S"), F.array(F.lit("old"), F.lit("rings"))).otherwise(F.array(F.lit("old")))
    united = F.array_union(had, S.topics(F.col("p_name"), [("ring", "rings")]))
    return t("part").filter(F.size(united) > F.size(had)).select("p_partkey", F.array_join(united, ",").alias("topics"))


@query("rst05_cited_works", "SELECT l_orderkey, lower(p_name) AS title, CAST(max(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1990 END) AS INTEGER) AS year FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 10 <> 0 GROUP BY 1, 2, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1990 END")
def rst05(t: Tables) -> DataFrame:
    """One row a source, title in any case and year, an unknown one counting as 0; what the target has is left out."""
    rows = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("title")), "l_partkey")
    works = rows.select("l_orderkey", "title", F.coalesce(F.when(F.col("l_linenumber") % 2 != 0, 1990), F.lit(0)).alias("year")).distinct()
    have = t("orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return works.join(have, "l_orderkey", "left_anti")


@query("rst10_created_datasets", "SELECT DISTINCT '10.5061/d' || (l_partkey % 100) AS doi, min(l_orderkey) OVER (PARTITION BY l_partkey % 100) AS first_item FROM lineitem WHERE l_partkey % 100 >= 20")
def rst10(t: Tables) -> DataFrame:
    """DOIs of repositories that no dataset has become datasets, with the first item that names them."""
    named = t("lineitem").select(F.expr("concat('10.5061/D', l_partkey % 100)").alias("raw"), "l_orderkey")
    from tarn.functions.text import normal_doi

    known = t("part").filter("p_partkey < 20").select(F.expr("concat('10.5061/d', p_partkey)").alias("doi"))
    return named.groupBy(normal_doi(F.col("raw")).alias("doi")).agg(F.min("l_orderkey").alias("first_item")).join(known, "doi", "left_anti")


@query("rst21_panels", "SELECT a.entity_id, b.entity_id AS other, count(DISTINCT a.item_id) AS shared FROM entity_mentions a JOIN entity_mentions b ON a.item_id = b.item_id AND a.entity_type = 'supplier' AND b.entity_type = 'part' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY count(DISTINCT a.item_id) DESC, b.entity_id) <= 5")
def rst21(t: Tables) -> DataFrame:
    """Of every supplier the parts it occurs with most."""
    of = lambda kind, n: t.entity_mentions().filter(F.col("entity_type") == kind).select("item_id", F.col("entity_id").alias(n)).distinct()
    counts = of("supplier", "entity_id").join(of("part", "other"), "item_id").groupBy("entity_id", "other").agg(F.count("*").alias("shared"))
    return browse.top_per_group(counts, ["entity_id"], [F.desc("shared"), F.col("other")], 5).drop("rn")

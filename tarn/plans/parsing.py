"""Queries: parsers held against what the strings were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import names
from tarn.functions import text as X
from tarn.plans.registry import query
from tarn.sources.tables import Tables

# Strings are made of part columns by SQL that both engines run; the parsers must find the pieces again.
FIRST, SECOND = "concat(upper(left(split_part(p_name, ' ', 1), 1)), substr(split_part(p_name, ' ', 1), 2))", "concat(upper(left(split_part(p_name, ' ', 2), 1)), substr(split_part(p_name, ' ', 2), 2))"
A, B = "chr(CAST(65 + p_partkey % 26 AS INTEGER))", "chr(CAST(65 + p_size % 26 AS INTEGER))"


@query("str02_extract_doi", """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE concat('10.1234/ab', p_partkey) END AS doi FROM part""")
def str02(t: Tables) -> DataFrame:
    made = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN 'see https://doi.org/' WHEN 1 THEN 'doi: ' WHEN 2 THEN 'http://dx.doi.org/' ELSE 'none 10.12/' END, if(p_partkey % 4 = 3, 'x', concat('10.1234/ab', p_partkey)), '.,)')")
    return t("part").select("p_partkey", X.extract_doi(made).alias("doi"))


@query("str03_doi_status", """SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN concat('10.1234/x', p_partkey) END AS doi,
    CASE p_partkey % 6 WHEN 3 THEN 'pending' WHEN 4 THEN 'none' WHEN 5 THEN 'invalid' ELSE 'valid' END AS status FROM part""")
def str03(t: Tables) -> DataFrame:
    raw = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat('10.1234/X', p_partkey) WHEN 1 THEN concat('https://doi.org/10.1234/x', p_partkey) WHEN 2 THEN concat('0.1234/x', p_partkey) WHEN 3 THEN ' In Press' WHEN 4 THEN ' ' ELSE 'abc' END")
    return t("part").select("p_partkey", X.doi_status(raw).alias("s")).select("p_partkey", "s.doi", "s.status")


@query("str04_normal_doi", "SELECT p_partkey, concat('10.5/q', p_partkey) AS doi FROM part")
def str04(t: Tables) -> DataFrame:
    raw = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN 'HTTPS://DOI.ORG/' WHEN 1 THEN ' http://dx.doi.org/' WHEN 2 THEN 'doi.org/' ELSE '' END, '10.5/Q', p_partkey, ' ')")
    return t("part").select("p_partkey", X.normal_doi(raw).alias("doi"))


@query("str09_byline", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat({FIRST}, CASE WHEN p_partkey % 3 = 1 THEN concat(' ', {A}, '. ') ELSE ' ' END, {SECOND}) END AS author FROM part")
def str09(t: Tables) -> DataFrame:
    made = F.expr(f"concat('<p>', if(p_partkey % 3 = 0, 'by nobody. ', concat('By ', {FIRST}, if(p_partkey % 3 = 1, concat(' ', {A}, '. '), ' '), {SECOND}, '<br>')), ' text By and by')")
    return t("part").select("p_partkey", X.byline(made).alias("author"))


@query("str10_author_lists", f"""SELECT p_partkey, 0 AS pos, concat({A}, '. ', {B}, '.') AS given, {FIRST} AS family FROM part UNION ALL SELECT p_partkey, 1, concat({B}, '.'), concat('de ', {SECOND}) FROM part
    UNION ALL SELECT p_partkey, 2, {FIRST}, concat('van ', {SECOND}) FROM part UNION ALL SELECT p_partkey, 3, '', {SECOND} FROM part""")
def str10(t: Tables) -> DataFrame:
    raw = F.expr(f"concat({FIRST}, ' ', {A}, {B}, ', de ', {SECOND}, ' ', {B}, '*, ', {FIRST}, '  van ', {SECOND}, ',', {SECOND}, ', et al.')")
    return t("part").select("p_partkey", F.posexplode(names.parse_authors(raw)).alias("pos", "a")).select("p_partkey", "pos", "a.given", "a.family")


@query("str11_creators_and_editors", f"""SELECT p_partkey, 'inverted' AS kind, concat({FIRST}, ' ', {A}, '.') AS given, {SECOND} AS family, concat({FIRST}, ' ', {A}, '. ', {SECOND}) AS shown FROM part
    UNION ALL SELECT p_partkey, 'plain', concat({FIRST}, ' ', {A}, '.'), {SECOND}, concat({FIRST}, ' ', {A}, '. ', {SECOND}) FROM part UNION ALL SELECT p_partkey, 'alone', '', {SECOND}, {SECOND} FROM part
    UNION ALL SELECT p_partkey, 'compact', concat({A}, {B}), {SECOND}, concat({A}, '. ', {B}, '. ', {SECOND}) FROM part
    UNION ALL SELECT p_partkey, 'editor first', concat({A}, '. ', {B}, '.'), {FIRST}, concat({A}, '. ', {B}, '. ', {FIRST}) FROM part UNION ALL SELECT p_partkey, 'editor last', concat({B}, '.'), {SECOND}, concat({B}, '. ', {SECOND}) FROM part""")
def str11(t: Tables) -> DataFrame:
    forms = {"inverted": f"concat({SECOND}, ', ', {FIRST}, ' ', {A}, '.')", "plain": f"concat({FIRST}, ' ', {A}, '. ', {SECOND})", "alone": SECOND, "compact": f"concat({SECOND}, ', ', {A}, {B})"}
    parsed = F.array(*(F.struct(F.lit(k).alias("kind"), names.parse_creator(F.expr(e)).alias("n")) for k, e in forms.items()))
    editors = names.parse_editors(F.expr(f"concat({A}, '. ', {B}, '. ', {FIRST}, ' and ', {SECOND}, ' ', {B})"))
    tagged = F.zip_with(F.array(F.lit("editor first"), F.lit("editor last")), editors, lambda k, n: F.struct(k.alias("kind"), n.alias("n")))
    rows = t("part").select("p_partkey", F.inline(F.concat(parsed, tagged)))
    return rows.select("p_partkey", "kind", "n.given", "n.family", names.display_name(F.col("n.given"), F.col("n.family")).alias("shown"))


@query("str14_author_key", f"SELECT p_partkey, lower({SECOND}) || ' jr|' || lower({A}) AS key FROM part")
def str14(t: Tables) -> DataFrame:
    family, given = F.expr(f"concat({SECOND}, '  ''Jr.''')"), F.expr(f"concat({A}, '. ', {B}, '.')")
    return t("part").select("p_partkey", names.author_key(family, given).alias("key"))


@query("str15_signature", f"SELECT p_partkey, concat({A}, {B}) AS signature FROM part")
def str15(t: Tables) -> DataFrame:
    given = F.expr(f"CASE p_partkey % 3 WHEN 0 THEN concat({A}, '.', {B}, '.') WHEN 1 THEN concat({A}, 'ohn ', lower({B}), 'lan') ELSE concat({A}, '. ', {B}, 'en') END")
    return t("part").select("p_partkey", names.signature(given).alias("signature"))


@query("str16_initials_match", f"""SELECT p_partkey, {A} = {B} AS one, {A} = {A} AND {A} = {B} AS two, false AS none FROM part""")
def str16(t: Tables) -> DataFrame:
    full, single, double = F.expr(f"concat({A}, 'nna ', {A}, '.')"), F.expr(f"concat(lower({B}), '.')"), F.expr(f"concat({A}, '. ', {B}, '.')")
    return t("part").select("p_partkey", names.initials_match(full, single).alias("one"), names.initials_match(full, double).alias("two"), names.initials_match(full, F.lit(" . ")).alias("none"))


@query("str18_place_names", f"SELECT p_partkey, lower(concat({FIRST}, ' ', {SECOND})) AS place FROM part")
def str18(t: Tables) -> DataFrame:
    raw = F.expr(f"concat(CASE p_partkey % 3 WHEN 0 THEN 'Near ' WHEN 1 THEN 'the ' ELSE '' END, {FIRST}, ' ', {SECOND}, CASE p_partkey % 2 WHEN 0 THEN ', USA' ELSE '' END)")
    return t("part").select("p_partkey", X.place_name(raw).alias("place"))


@query("str21_licence", """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'CC0-1.0' WHEN 2 THEN 'CC-BY-NC-SA' WHEN 3 THEN 'CC-BY-NC' WHEN 4 THEN 'CC-BY' WHEN 5 THEN 'MIT' WHEN 6 THEN 'Apache-2.0' ELSE 'other' END AS licence FROM documents""")
def str21(t: Tables) -> DataFrame:
    raw = F.expr("CASE doc_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'Dedicated to the Public Domain' WHEN 2 THEN 'CC BY-NC-SA 4.0' WHEN 3 THEN 'cc-by-nc' WHEN 4 THEN 'https://creativecommons.org/licenses/by/4.0' WHEN 5 THEN 'The MIT License' WHEN 6 THEN 'APACHE 2' ELSE 'own terms' END")
    return t("documents").select("doc_id", X.licence(raw).alias("licence"))


@query("str23_first_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) || '-01-01' END AS day FROM orders")
def str23(t: Tables) -> DataFrame:
    made = F.expr("concat('report 12345 of 1899, ', if(o_orderkey % 5 = 0, 'undated 2030', concat(date_format(o_orderdate, 'MMM yyyy'), ' and 2001')))")
    return t("orders").select("o_orderkey", X.first_year(made).alias("day"))


@query("str24_text_quality", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.2 ELSE 0.9 END::DOUBLE AS score FROM documents""")
def str24(t: Tables) -> DataFrame:
    """Blank; short and not words; long words with ten replacement characters."""
    made = F.expr("CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '1 2 3 4' ELSE concat(repeat('word other, ', 60), repeat('\\uFFFD', 10)) END")
    return t("documents").select("doc_id", F.round(X.quality_score(made), 6).alias("score"))


@query("str29_name_similarity", """SELECT p_partkey, round(greatest(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)),
    len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS similarity FROM (SELECT *, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(lower(p_name), CAST(i AS INTEGER), 3))) AS x,
    list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: substring(lower(p_type), CAST(i AS INTEGER), 3))) AS y FROM part) p""")
def str29_names(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.round(X.name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("str30_camel", "SELECT s_suppkey, 'accountBalance' || s_suppkey || 'Of' AS name FROM supplier")
def str30(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", X.camel(F.expr("concat('account_balance', s_suppkey, '_of')")).alias("name"))


@query("str33_sanitised", "SELECT doc_id, left('a' || doc_id || 'b c', 5) AS text FROM documents")
def str33(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.sanitised(F.expr("concat(' a', char(7), doc_id, char(0), 'b c ', char(127))"), 5).alias("text"))


@query("str35_citation_label", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN {FIRST} WHEN 2 THEN {FIRST} || ' & ' || {SECOND} ELSE {FIRST} || ' et al.' END AS label FROM part")
def str35(t: Tables) -> DataFrame:
    people = F.expr(f"slice(array({FIRST}, {SECOND}, 'Third'), 1, cast(p_partkey % 4 as int))")
    return t("part").select("p_partkey", X.citation_label(people).alias("label"))


@query("str39_embedding_text", """SELECT doc_id, left(source || '. ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), 1, 500), ' ') END, 32000) AS prepared FROM documents""")
def str39(t: Tables) -> DataFrame:
    abstract = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return t("documents").select("doc_id", X.embedding_text(F.col("source"), abstract, F.col("text")).alias("prepared"))


@query("str41_name_parts", f"SELECT p_partkey, {SECOND} AS family, split_part(p_name, ' ', 1) AS keyword, concat({FIRST}, ' ', {SECOND}) AS flat FROM part")
def str41(t: Tables) -> DataFrame:
    full = F.expr(f"concat(' ', {FIRST}, ' van ', {SECOND}, ' ')")
    keywords = X.keywords(F.expr("concat(split_part(p_name, ' ', 1), ' ; ', p_type, ',')"))
    return t("part").select("p_partkey", names.family_name(full).alias("family"), F.get(keywords, F.lit(0)).alias("keyword"), X.flattened(F.expr(f"concat({FIRST}, ' \\n\\r\\n ', {SECOND})")).alias("flat"))


@query("arr04_inverted_index", "SELECT p_partkey, p_name || ' of ' || p_name AS text FROM part")
def arr04(t: Tables) -> DataFrame:
    """Words with their places, back to the text."""
    words = F.split(F.expr("concat(p_name, ' of ', p_name)"), " ")
    places = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, places(w))))
    return t("part").select("p_partkey", X.from_inverted_index(index).alias("text"))


@query("jsn01_tolerant_json", "SELECT p_partkey, p_name AS name FROM part")
def jsn01(t: Tables) -> DataFrame:
    fenced = F.expr("""concat(CASE p_partkey % 3 WHEN 0 THEN 'Here it is:\n```json\n' WHEN 1 THEN 'Sure. ' ELSE '' END, '{"name": "', p_name, '", "inner": {"a": 1}}', CASE p_partkey % 3 WHEN 0 THEN '\n``` Anything else?' WHEN 1 THEN ' Done.' ELSE '' END)""")
    return t("part").select("p_partkey", F.get_json_object(X.tolerant_json(fenced), "$.name").alias("name"))


@query("xml01_elements", "SELECT p_partkey, p_name AS title, p_brand || '|' || p_type AS people FROM part")
def xml01(t: Tables) -> DataFrame:
    made = F.expr("""concat('<eml:eml><title lang="en">', split_part(p_name, ' ', 1), ' <b>', split_part(p_name, ' ', 2), '</b></title><surName>', p_brand, '</surName>\n<d:surName a="1">', p_type, '</d:surName></eml:eml>')""")
    return t("part").select("p_partkey", X.xml_text(made, "title").alias("title"), F.array_join(X.xml_texts(made, "surName"), "|").alias("people"))


@query("nrm01_works", f"""SELECT p_partkey, concat('openalex:W', p_partkey) AS source_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN concat('10.7/', p_partkey) END AS doi, {SECOND} AS family, concat({FIRST}, ' ', {A}, '.') AS given,
    1900 + p_size AS year, CASE WHEN p_partkey % 3 = 0 THEN 'article' ELSE 'other' END AS kind, concat(p_size, '-', p_size + 9) AS pages, p_type AS keywords, p_name || ' ' || p_name AS abstract FROM part""")
def nrm01(t: Tables) -> DataFrame:
    from tarn.operators import normalise

    doi = F.expr("if(p_partkey % 2 = 0, concat('https://doi.org/10.7/', p_partkey), null)")
    people = F.array(F.struct(F.struct(F.expr(f"concat({FIRST}, ' ', {A}, '. ', {SECOND})").alias("display_name"), F.lit("https://orcid.org/0000-0001").alias("orcid")).alias("author")))
    concepts = F.array(F.struct(F.col("p_type").alias("display_name"), F.lit(0.9).alias("score")), F.struct(F.lit("rare").alias("display_name"), F.lit(0.3).alias("score")))
    words = F.split(F.expr("concat(p_name, ' ', p_name)"), " ")
    places = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    works = t("part").select(
        "p_partkey", F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), doi.alias("doi"), people.alias("authorships"), (F.col("p_size") + 1900).alias("publication_year"),
        F.when(F.col("p_partkey") % 3 == 0, "journal-article").otherwise("dataset-x").alias("type"), concepts.alias("concepts"),
        F.struct(F.col("p_size").cast("string").alias("first_page"), (F.col("p_size") + 9).cast("string").alias("last_page")).alias("biblio"),
        F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, places(w)))).alias("abstract_inverted_index"),
    )
    made = normalise.openalex_works(works)
    return made.select("p_partkey", "source_id", "title", "doi", F.col("authors")[0]["family"].alias("family"), F.col("authors")[0]["given"].alias("given"), "year", "kind", "pages", F.array_join("keywords", ",").alias("keywords"), "abstract")


@query("nrm01_crossref", f"""SELECT p_partkey, concat('crossref:10.8/', p_partkey) AS source_id, p_name AS title, {SECOND} AS family, CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size ELSE 1900 + p_size END AS year, 'chapter' AS kind, p_type AS abstract FROM part""")
def nrm01_crossref(t: Tables) -> DataFrame:
    from tarn.operators import normalise

    date = lambda base: F.struct(F.array(F.array(F.col("p_size") + base)).alias("date-parts"))
    items = t("part").select(
        "p_partkey", F.concat(F.lit("10.8/"), F.col("p_partkey").cast("string")).alias("DOI"), F.array("p_name", F.lit("short")).alias("title"), F.lit("book-chapter").alias("type"),
        F.array(F.struct(F.expr(FIRST).alias("given"), F.expr(SECOND).alias("family"), F.lit("http://orcid.org/0000").alias("ORCID"))).alias("author"),
        F.when(F.col("p_partkey") % 2 == 0, date(1950)).alias("published-print"), date(1900).alias("issued"), F.expr("concat('<jats:p> ', p_type, '</jats:p>')").alias("abstract"),
    )
    made = normalise.crossref_works(items)
    return made.select("p_partkey", "source_id", "title", F.col("authors")[0]["family"].alias("family"), "year", "kind", "abstract")


@query("nrm03_source_routing", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'datacite' WHEN 1 THEN 'eml' WHEN 2 THEN 'xml' ELSE 'unknown' END AS route FROM part")
def nrm03(t: Tables) -> DataFrame:
    from tarn.operators import normalise

    raw = F.expr("""CASE p_partkey % 4 WHEN 0 THEN '{"data": {"attributes": {"doi": "10.1/x"}}}' WHEN 1 THEN '<?xml version="1.0"?><eml:eml packageId="1">' WHEN 2 THEN ' <metadata>' ELSE 'plain text' END""")
    return t("part").select("p_partkey", normalise.route(raw).alias("route"))

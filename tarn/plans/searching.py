"""Queries: stemmed search over a stored index, ranking, unified results, quick matches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.stemmer import stem, stem_sql
from tarn.operators import search, text_index
from tarn.operators.storage import shared_dir
from tarn.plans.registry import query
from tarn.sources.tables import Tables

STOPS = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
ENDINGS = ("", "s", "es", "ed", "ing", "ings", "ly", "edly", "ingly", "er", "ers", "e", "ful", "fully", "ness", "al", "ation", "y", "ies", "lyed", "lying", "lyings", "lyedly", "lyingly")


def _forms(term: str) -> str:
    """The forms of a term as a list in SQL."""
    return ", ".join(f"'{term}{e}'" for e in ENDINGS if stem(term + e) == term)


def _words_sql(name: str, source: str, key: str, title: str, body: str) -> str:
    """Rows id, weight, word and place of a collection with a title (A) and a body (D)."""
    split = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')".format
    return f"""{name}_s AS (SELECT {key} AS id, {split(title)} AS a, {split(body)} AS d FROM {source}),
    {name} AS (SELECT id, 1.0::DOUBLE AS w, unnest(a) AS word, generate_subscripts(a, 1) AS place FROM {name}_s UNION ALL SELECT id, 0.1::DOUBLE, unnest(d), len(a) + generate_subscripts(d, 1) FROM {name}_s)"""


def _rank_sql(name: str, term: str) -> str:
    return f"""{name}_j AS (SELECT id, w, place, row_number() OVER (PARTITION BY id ORDER BY place) AS j FROM {name} WHERE word IN ({_forms(term)})),
    {name}_m AS (SELECT id, max(w) AS top, sum(w / (j * j)) AS damped, arg_min(j, (-w, j)) AS f FROM {name}_j GROUP BY 1),
    {name}_r AS (SELECT id, (top + damped - top / (f * f)) / 1.64493406685 AS rank FROM {name}_m)"""


DOCS = _words_sql("d", "documents", "doc_id", "source", "text")


def _documents(t: Tables, language: str = "english") -> text_index.TextIndex:
    return text_index.kept_index(t("documents"), "doc_id", {"A": "source", "D": "text"}, language)


INDEXED = f"""v AS (SELECT DISTINCT word FROM d WHERE word NOT IN ({STOPS})), s AS ({stem_sql('SELECT word FROM v')}),
    t AS (SELECT 'english' AS language, term, id, w, place FROM d JOIN s USING (word) UNION ALL SELECT 'simple', word, id, w, place FROM d)"""


@query("fts01_stored_index", f"WITH {DOCS}, {INDEXED} SELECT language, term, count(DISTINCT id) AS documents, count(*) AS places, CAST(sum(place) AS BIGINT) AS ats, CAST(sum(round(w * 10)) AS BIGINT) AS weights FROM t GROUP BY 1, 2")
def fts01(t: Tables) -> DataFrame:
    """Every stem of the English index, stop words left out, and every word of the simple one as it stands: in how many documents,
    where, and with what weights."""
    heavy = F.length(F.regexp_replace("weights", "[^A]", ""))
    sums = F.aggregate("ats", F.lit(0).cast("long"), lambda s, x: s + x)
    own = lambda language: _documents(t, language).postings().select(F.lit(language).alias("language"), "term", F.size("ats").alias("n"), sums.alias("ats"), (heavy * 10 + F.length("weights") - heavy).alias("w"))
    rows = own("english").unionByName(own("simple"))
    return rows.groupBy("language", "term").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("places"), F.sum("ats").alias("ats"), F.sum("w").cast("long").alias("weights"))


@query("fts02_stemmed_match", f"""WITH {DOCS}, h AS (SELECT id, w, place, word IN ({_forms('hand')}) AS first FROM d WHERE word IN ({_forms('hand')}, {_forms('thing')})),
    b AS (SELECT id FROM h GROUP BY 1 HAVING bool_or(first) AND bool_or(NOT first)),
    p AS (SELECT x.id, 1 - exp(sum(ln(1 - sqrt(x.w * y.w / (1.005 + 0.05 * exp(abs(x.place - y.place) / 1.5 - 2)))))) AS rank FROM h x JOIN h y ON x.id = y.id AND x.first AND NOT y.first AND abs(x.place - y.place) <= 100 GROUP BY 1)
    SELECT id, round(coalesce(rank, 0), 6) AS rank FROM b LEFT JOIN p USING (id)""")
def fts02_stemmed(t: Tables) -> DataFrame:
    """Stop words of the query are no condition; inflected forms count; the nearer the terms stand, the higher the rank."""
    return _documents(t).ranked("the Things and HANDED").select("id", F.round("rank", 6).alias("rank"))


@query("fts03_stemmed_phrase", f"WITH {DOCS} SELECT DISTINCT a.id FROM d a JOIN d b ON a.id = b.id AND a.word IN ({_forms('er')}) AND b.word IN ({_forms('en')}) AND b.place = a.place + 1 UNION SELECT id FROM d WHERE word IN ({_forms('trash')})")
def fts03_stemmed(t: Tables) -> DataFrame:
    """Either of two phrases, by places in the index."""
    own = _documents(t)
    return own.phrase("er en").unionByName(own.phrase("trash")).distinct()


@query("fts04_conjunctions", f"WITH {DOCS} SELECT id FROM d GROUP BY 1 HAVING bool_or(word IN ({_forms('er')})) AND bool_or(word IN ({_forms('thing')})) UNION SELECT id FROM d WHERE word IN ({_forms('licens')})")
def fts04(t: Tables) -> DataFrame:
    """``er & thing | license``, raw; parts without a word are ignored."""
    return _documents(t).any_of(["er & things", "license", "& !"])


@query("fts05_ranked", f"WITH {DOCS}, {_rank_sql('d', 'src1')} SELECT id, round(rank, 6) AS rank FROM d_r")
def fts05(t: Tables) -> DataFrame:
    """A term of the title counts ten times one of the text."""
    return _documents(t).ranked("SRC1").select("id", F.round("rank", 6).alias("rank"))


@query("fts05_additions_and_deletions", f"""WITH {DOCS}, {_rank_sql('d', 'thing')} SELECT id, round(rank, 6) AS rank FROM d_r WHERE id % 5 <> 1 OR id % 2 = 0""")
def fts05_changes(t: Tables) -> DataFrame:
    """An index that grew by two segments and lost documents, of which some came back."""
    docs, folder = t("documents"), f"{shared_dir(t.spark)}/text-index-{uuid.uuid4().hex}"
    index = text_index.TextIndex.create(t.spark, folder, {"A": "source", "D": "text"})
    index = index.append(docs.filter("doc_id % 3 = 0"), "doc_id").append(docs.filter("doc_id % 3 <> 0"), "doc_id")
    index = index.delete(docs.filter("doc_id % 5 = 1").select("doc_id")).append(docs.filter("doc_id % 5 = 1 and doc_id % 2 = 0"), "doc_id")
    return index.ranked("things").select("id", F.round("rank", 6).alias("rank"))


COLLECTIONS = ", ".join((DOCS, _words_sql("p", "pages", "page_id", "url", "regexp_replace(html, '<[^>]*>', ' ', 'g')"), _words_sql("b", "benchmark", "item_id", "''", "text")))


@query("fts06_unified_search", f"""WITH {COLLECTIONS}, {_rank_sql('d', 'thing')}, {_rank_sql('p', 'thing')}, {_rank_sql('b', 'thing')},
    u AS (SELECT * FROM (SELECT 'document' AS collection, id, rank FROM d_r ORDER BY round(rank, 9) DESC, id LIMIT 12 OFFSET 3) x UNION ALL SELECT * FROM (SELECT 'page', id, rank FROM p_r ORDER BY round(rank, 9) DESC, id LIMIT 12 OFFSET 3) y
      UNION ALL SELECT * FROM (SELECT 'question', id, rank FROM b_r ORDER BY round(rank, 9) DESC, id LIMIT 12 OFFSET 3) z)
    SELECT collection, id, round(rank, 6) AS rank, (SELECT count(*) FROM d_r) + (SELECT count(*) FROM p_r) + (SELECT count(*) FROM b_r) AS total FROM u ORDER BY round(rank, 9) DESC, collection, id LIMIT 12""")
def fts06(t: Tables) -> DataFrame:
    pages = t("pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    benchmark = t("benchmark").select("item_id", F.lit("").alias("title"), "text")
    indexes = {"document": _documents(t), "page": text_index.kept_index(pages, "page_id", {"A": "url", "D": "text"}), "question": text_index.kept_index(benchmark, "item_id", {"A": "title", "D": "text"})}
    return text_index.unified(indexes, "a thing", 12, 3).withColumn("rank", F.round("rank", 6))


@query("fts07_browse", """WITH RECURSIVE below AS (SELECT id FROM topics WHERE id = 2 UNION ALL SELECT t.id FROM below JOIN topics t ON t.parent_id = below.id)
    SELECT item_id, year, cites FROM items WHERE owner_id IN (SELECT id FROM below) AND year >= 1993 AND subtype IN ('1-URGENT', '5-LOW') ORDER BY year DESC, item_id LIMIT 40""")
def fts07(t: Tables) -> DataFrame:
    """A topic and all topics below it, with filters and a sort, without a query."""
    from tarn.operators import browse

    below = browse.lineage(t.topics(), "id", "parent_id", 12).filter("ancestor = 2").select(F.col("leaf").alias("owner_id"))
    wanted = browse.where_all(t.items(), F.col("year") >= 1993, F.col("subtype").isin("1-URGENT", "5-LOW"))
    return browse.page(wanted.join(below, "owner_id", "left_semi").select("item_id", "year", "cites"), [F.desc("year"), F.col("item_id")], 40)


@query("fts08_quick_match", """SELECT * FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS n FROM part WHERE p_name ILIKE '%ing%' ORDER BY n DESC, id LIMIT 5) a
    UNION ALL SELECT * FROM (SELECT 'author', s_suppkey, s_name, CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_name ILIKE '%ing%' ORDER BY 4 DESC, 2 LIMIT 5) b UNION ALL SELECT * FROM (SELECT 'segment', c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) FROM customer WHERE c_mktsegment ILIKE '%ing%' ORDER BY 4 DESC, 2 LIMIT 5) c""")
def fts08(t: Tables) -> DataFrame:
    return search.quick_match({"part": (t("part"), "p_partkey", "p_name", "p_size"), "author": (t("supplier"), "s_suppkey", "s_name", "s_nationkey"), "segment": (t("customer"), "c_custkey", "c_mktsegment", "c_nationkey")}, "ING")

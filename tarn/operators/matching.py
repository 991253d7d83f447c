"""References, authors and stories matched to what a collection has, in stages that each take what the one before left."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import names
from tarn.functions import text as X
from tarn.operators.browse import first_per_group
from tarn.operators.resolve import group_pairs, set_similarity_join, title_pairs, with_group
from tarn.operators.storage import stored

# A title in an unstructured citation: what follows the year, up to the next full stop or comma.
ROUGH_TITLE = r"(?:19|20)\d{2}[).,]\s*(.{20,100}?)[.,]"


def _by_doi(refs: DataFrame, publications: DataFrame, datasets: DataFrame) -> DataFrame:
    """Equal DOIs: publications before datasets, then the least id."""
    known = lambda df, name, p: df.select(X.normal_doi(F.col("doi")).alias("k"), F.lit(name).alias("collection"), F.col("id").alias("target"), F.lit(p).alias("p")).filter("k is not null")
    both = known(publications, "publication", 0).unionByName(known(datasets, "dataset", 1))
    best = both.groupBy("k").agg(F.min_by(F.struct("collection", "target"), F.struct("p", "target")).alias("b"))
    own = refs.select("id", X.normal_doi(F.col("doi")).alias("k")).filter("k is not null")
    return own.join(best, "k").select("id", "b.collection", "b.target", F.lit("doi").alias("method"), F.lit(1.0).alias("confidence"))


def match_references(refs: DataFrame, publications: DataFrame, datasets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """References (id, doi, title, raw) against publications (id, doi, title) and datasets (id, doi): one row a reference with
    collection, target, method and confidence; what matches nothing is external.

    In order: the DOI of a publication, of a dataset; the most similar title over the threshold; without a title, the first
    publication whose title is that similar to the one in the raw citation.  Null keys match nothing.
    """
    doi = _by_doi(refs, publications, datasets)
    left = refs.join(doi.select("id"), "id", "left_anti")
    blank = F.trim(F.coalesce("title", F.lit(""))) == ""
    rough = F.nullif(F.trim(F.regexp_extract(F.coalesce("raw", F.lit("")), ROUGH_TITLE, 1)), F.lit(""))
    asked = left.select("id", blank.alias("rough"), F.when(blank, rough).otherwise(F.col("title")).alias("title")).filter("title is not null")
    asked, known = with_group(asked, "rough"), with_group(publications.filter(F.trim(F.coalesce("title", F.lit(""))) != ""))
    pairs = group_pairs(asked, known, threshold).join(asked.select(F.col("_g").alias("left_g"), "rough").distinct(), "left_g")
    named = pairs.join(known.groupBy(F.col("_g").alias("right_g")).agg(F.min("id").alias("right_id")), "right_g")
    order = F.struct(F.when(F.col("rough"), 0.0).otherwise(-F.col("similarity")).alias("s"), "right_id")
    best = asked.join(named.groupBy(F.col("left_g").alias("_g")).agg(F.min_by(F.struct("right_id", "similarity"), order).alias("b")), "_g")
    titled = best.select("id", F.lit("publication").alias("collection"), F.col("b.right_id").alias("target"), F.lit("title").alias("method"), F.col("b.similarity").alias("confidence"))
    found = doi.unionByName(titled)
    return refs.select("id").join(found, "id", "left").withColumn("link_type", F.when(F.col("target").isNull(), "external").otherwise("internal"))


def match_by_trigrams(refs: DataFrame, stages: list[tuple[str, DataFrame]], threshold: float = 0.8, years: int = 2, least: int = 10) -> DataFrame:
    """References (id, title, year, own) against the collections one after another (name; id, title, year): the best title of the
    first collection with one at or over the threshold by trigrams, years at most ``years`` apart or unknown.  A row is not
    matched to itself (``own``: the collection and id it is, or null)."""
    left = refs.filter(F.length(F.trim("title")) >= least)
    out = None
    for name, collection in stages:
        pairs = set_similarity_join(left.select("id", "title"), collection.select("id", "title"), threshold, strict=False, tokens=X.trigrams(F.col("title")))
        dated = pairs.join(left.select(F.col("id").alias("left_id"), F.col("year").alias("_y"), "own"), "left_id").join(collection.select(F.col("id").alias("right_id"), F.col("year").alias("_z")), "right_id")
        near = F.coalesce(F.abs(F.col("_y") - F.col("_z")) <= years, F.lit(True))
        other = ~F.col("own").eqNullSafe(F.struct(F.lit(name).alias("collection"), F.col("right_id").alias("id")))
        best = dated.filter(near & other).groupBy(F.col("left_id").alias("id")).agg(F.min_by(F.struct("right_id", "similarity"), F.struct(-F.col("similarity"), "right_id")).alias("b"))
        found = best.select("id", F.lit(name).alias("collection"), F.col("b.right_id").alias("target"), F.round("b.similarity", 6).alias("confidence"))
        found = stored(found, "matched")  # the later stages read it, so it is worked once
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("id"), "id", "left_anti")
    return out


def dedupe_authors(authors: DataFrame) -> DataFrame:
    """(id, canonical_id, family, given, orcid): which author each one is merged into, and that author's names.

    Authors of one ORCID are one.  Then, family by family and in the order of ids, an author takes in each later one whose
    given name may be the same person's; the longer given name stays, and decides about the next.  A family's given names are
    told apart first, so what one task holds is one family's different given names.  Authors without a given name stay alone.
    """
    first = authors.filter("orcid is not null and orcid <> ''").groupBy("orcid").agg(F.min("id").alias("rep"))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("id")))
    tagged = authors.join(first, "orcid", "left").withColumn("rep", F.coalesce("rep", "id"))
    reps = tagged.groupBy("rep").agg(longest("family").alias("family"), longest("given").alias("given"), F.max("orcid").alias("orcid"))
    keyed = reps.withColumns({"fam": F.lower("family"), "given": F.coalesce("given", F.lit(""))})
    variants = keyed.filter("given <> ''").groupBy("fam", "given").agg(F.min("rep").alias("least"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []  # canonical id, given name so far
        out = []
        for fam, given, least in pdf.sort_values("least").itertuples(index=False):
            home = next((k for k in kept if _may_be(k[1], given)), None)
            if home is None:
                home = [least, given]
                kept.append(home)
            elif len(given) > len(home[1]):
                home[1] = given
            out.append((fam, given, home))
        return pd.DataFrame([(fam, given, home[0], home[1]) for fam, given, home in out], columns=["fam", "given", "canonical_id", "best"])

    kind = dict(authors.dtypes)["id"]
    merged = variants.select("fam", "given", "least").groupBy("fam").applyInPandas(greedy, f"fam string, given string, canonical_id {kind}, best string")
    named = keyed.join(merged, ["fam", "given"], "left").withColumns({"canonical_id": F.coalesce("canonical_id", "rep"), "given": F.coalesce("best", "given")})
    orcids = named.groupBy("canonical_id").agg(F.max("orcid").alias("orcid"))
    owners = named.select(F.col("rep").alias("canonical_id"), "family").join(named.select("canonical_id").distinct(), "canonical_id", "left_semi")
    named = named.select("rep", "canonical_id", "given").join(orcids, "canonical_id").join(owners, "canonical_id")
    return tagged.select("id", "rep").join(named, "rep").select("id", "canonical_id", "family", "given", "orcid")


def _initials(given: str) -> list[str]:
    return [p[0].upper() for p in given.replace(".", " ").split()]


def _may_be(a: str, b: str) -> bool:
    """Whether two given names beside one family name may be one person's (``names.same_author``, for two strings)."""
    x, y = _initials(a), _initials(b)
    if not x or not y or any(p != q for p, q in zip(x, y, strict=False)):
        return False
    short = [len(g.replace(".", "").replace(" ", "")) <= 4 for g in (a, b)]
    low_a, low_b = a.lower(), b.lower()
    return any(short) or low_a.startswith(low_b) or low_b.startswith(low_a)


def link_authors(found: DataFrame, authors: DataFrame) -> DataFrame:
    """Names (id, given, family) linked to authors (author_id, given, family): ``full`` name, else family name and first initial
    where one author alone has them (``initial``), else ``new``.  Ties of full names go to the least id."""
    full = authors.groupBy(names.normal_name(F.col("family")).alias("f"), names.normal_name(F.col("given")).alias("g")).agg(F.min("author_id").alias("author_id"))
    asked = found.select("id", names.normal_name(F.col("family")).alias("f"), names.normal_name(F.col("given")).alias("g"))
    exact = asked.join(full, ["f", "g"]).select("id", "author_id", F.lit("full").alias("how"))
    one = authors.groupBy(names.author_key(F.col("family"), F.col("given")).alias("k")).agg(F.min("author_id").alias("author_id"), F.count_distinct("author_id").alias("n")).filter("n = 1")
    rest = found.join(exact.select("id"), "id", "left_anti").select("id", names.author_key(F.col("family"), F.col("given")).alias("k"))
    loose = rest.join(one, "k").select("id", "author_id", F.lit("initial").alias("how"))
    return found.select("id").join(exact.unionByName(loose), "id", "left").withColumn("how", F.coalesce("how", F.lit("new")))


def merge_plurals(entities: DataFrame, mentions: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, name) whose name is another's with an s go into it; mentions are pointed at what is left, and those
    that are then equal are one.  Returns (old_id, new_id) of what was merged, and the mentions."""
    low = entities.select("entity_id", F.lower("name").alias("n"))
    plural = low.filter(F.col("n").endswith("s") & (F.length("n") >= least)).select(F.col("entity_id").alias("old_id"), F.expr("left(n, length(n) - 1)").alias("n"))
    moved = plural.join(low.groupBy("n").agg(F.min("entity_id").alias("new_id")), "n").select("old_id", "new_id")
    pointed = mentions.join(moved.withColumnRenamed("old_id", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("new_id")
    return moved, pointed.select(mentions.columns).distinct()


def backfilled_mentions(docs: DataFrame, terms: DataFrame, mentions: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = 0.5) -> DataFrame:
    """New mentions (entity_id, item_id, confidence) of terms (entity_id, phrase) that stand word by word in a document and are
    not among the mentions (``linking.phrase_hits``)."""
    from tarn.operators.linking import phrase_hits

    hits = phrase_hits(docs, terms.select(F.col("entity_id").alias("phrase_id"), "phrase"), key, text)
    found = hits.select(F.col("phrase_id").alias("entity_id"), "item_id").distinct()
    return found.join(mentions.select("entity_id", "item_id"), ["entity_id", "item_id"], "left_anti").withColumn("confidence", F.lit(confidence))


def merge_extractions(rows: DataFrame, key: str, name: str, position: str, fields: list[str]) -> DataFrame:
    """What chunks of one document found, one row a name (in any case): the row with the most fields, of those the first."""
    filled = sum((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int") for f in fields)
    keyed = rows.filter(F.trim(F.coalesce(name, F.lit(""))) != "").withColumns({"_name": F.lower(F.trim(name)), "_filled": filled})
    return first_per_group(keyed, [key, "_name"], [F.desc("_filled"), F.col(position)]).drop("_name", "_filled")


def resolved_names(rows: DataFrame, name: str, maps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds ``kind`` and ``target``: the id under which the lower-case name is known in the first of the maps (kind; id, name)
    that has it; of equal names the least id counts."""
    known = None
    for p, (kind, df) in enumerate(maps):
        own = df.select(F.lower(F.trim("name")).alias("_n"), F.lit(kind).alias("kind"), F.col("id").alias("target"), F.lit(p).alias("_p"))
        known = own if known is None else known.unionByName(own)
    best = known.groupBy("_n").agg(F.min_by(F.struct("kind", "target"), F.struct("_p", "target")).alias("_b"))
    joined = rows.withColumn("_n", F.lower(F.trim(name))).join(best, "_n", "left")
    return joined.withColumns({"kind": F.col("_b.kind"), "target": F.col("_b.target")}).drop("_n", "_b")


def duplicates(candidates: DataFrame, existing: DataFrame, threshold: float, years: int | None = None) -> DataFrame:
    """Candidates (id, doi, title, year) with ``duplicate``: an existing row has the DOI, or a title over the threshold, with
    years at most ``years`` apart or unknown where ``years`` is given."""
    doi = existing.select(X.normal_doi(F.col("doi")).alias("k")).filter("k is not null").distinct()
    same = candidates.select("id", X.normal_doi(F.col("doi")).alias("k")).join(doi, "k", "left_semi").select("id")
    more = [] if years is None else ["year"]
    asked = with_group(candidates, *more)
    pairs = group_pairs(asked, with_group(existing, *more), threshold, *more)
    if years is not None:
        known = (F.coalesce("year_l", F.lit(0)) != 0) & (F.coalesce("year_r", F.lit(0)) != 0)
        pairs = pairs.filter(~known | (F.abs(F.col("year_l") - F.col("year_r")) <= years))
    titled = asked.select("id", "_g").join(pairs.select(F.col("left_g").alias("_g")).distinct(), "_g", "left_semi")
    hit = same.unionByName(titled.select("id")).distinct().withColumn("duplicate", F.lit(True))
    return candidates.join(hit, "id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def loaded(candidates: DataFrame, existing: DataFrame, years: int = 1) -> DataFrame:
    """The candidates to load: no existing row has the DOI, or the same title in any case with years at most ``years`` apart."""
    doi = existing.select(X.normal_doi(F.col("doi")).alias("k")).filter("k is not null").distinct()
    left = candidates.withColumn("k", X.normal_doi(F.col("doi"))).join(doi, "k", "left_anti").drop("k")
    near = F.explode(F.sequence(F.col("year") - years, F.col("year") + years)).alias("year")
    titles = existing.filter("title is not null and year is not null").select(F.lower("title").alias("_t"), near).distinct()
    return left.withColumn("_t", F.lower("title")).join(titles, ["_t", "year"], "left_anti").select(*candidates.columns)


def tombstoned(rows: DataFrame, stones: DataFrame, threshold: float = 0.9, years: int = 1) -> DataFrame:
    """Rows (id, doi, url, title, year) with ``stone``: by what a tombstone (doi, url, title, year) keeps them out: doi, url, title
    or null."""
    doi = stones.select(X.normal_doi(F.col("doi")).alias("_d")).filter("_d is not null").distinct().withColumn("_by_doi", F.lit(True))
    address = F.lower(F.regexp_replace(F.trim("url"), "/+$", ""))
    url = stones.select(address.alias("_u")).filter("_u <> ''").distinct().withColumn("_by_url", F.lit(True))
    asked = with_group(rows, "year")
    pairs = group_pairs(asked, with_group(stones.filter("title is not null"), "year"), threshold, "year")
    near = pairs.filter(F.coalesce(F.abs(F.col("year_l") - F.col("year_r")) <= years, F.lit(True)))
    titled = asked.select("id", "_g").join(near.select(F.col("left_g").alias("_g")).distinct(), "_g", "left_semi").select("id").distinct().withColumn("_by_title", F.lit(True))
    marked = rows.withColumns({"_d": X.normal_doi(F.col("doi")), "_u": address}).join(doi, "_d", "left").join(url, "_u", "left").join(titled, "id", "left")
    return marked.withColumn("stone", F.when(F.col("_by_doi"), "doi").when(F.col("_by_url"), "url").when(F.col("_by_title"), "title")).select(*rows.columns, "stone")


def upsert_stories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a story (id, url, title, text): of the same address, or without one of the same title; the longer text stays, of
    equally long ones that of the existing row."""
    key = F.when(F.trim(F.coalesce("url", F.lit(""))) != "", F.concat(F.lit("u:"), F.trim("url"))).otherwise(F.concat(F.lit("t:"), X.normal_title(F.col("title"))))
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).withColumn("_k", key)
    return first_per_group(both, ["_k"], [F.desc(F.length(F.coalesce("text", F.lit("")))), F.col("_new"), F.col("id")]).drop("_k", "_new")


def story_passes(stories: DataFrame, exact: list[str], patterns: list[str], threshold: float, relevant: list[str]) -> DataFrame:
    """Stories (id, title, text) with ``reason``: excluded by title, copy of an equal title, near copy of a longer or earlier story's
    title, not relevant (none of the words in title or text), or null for those that stay.  Each pass sees what is left."""
    from tarn.operators import selection

    out = stories.filter(selection.title_excluded(F.col("title"), exact, patterns)).select("id", F.lit("excluded").alias("reason"))
    left = stories.join(out, "id", "left_anti")
    order = [F.desc(F.length(F.coalesce("text", F.lit("")))), F.col("id")]
    kept = stored(first_per_group(left.withColumn("_t", F.lower("title")), ["_t"], order).drop("_t"), "stories-kept")
    titles = kept.select("id", "title")
    out = out.unionByName(left.join(kept.select("id"), "id", "left_anti").select("id", F.lit("copy").alias("reason")))
    size = lambda n: kept.select(F.col("id").alias(n), F.length(F.coalesce("text", F.lit(""))).alias(f"{n}_size"))
    pairs = title_pairs(titles, titles, threshold).filter("left_id < right_id").join(size("left_id"), "left_id").join(size("right_id"), "right_id")
    gone = pairs.select(F.when(F.col("right_id_size") > F.col("left_id_size"), F.col("left_id")).otherwise(F.col("right_id")).alias("id")).distinct()
    out = out.unionByName(gone.select("id", F.lit("near").alias("reason")))
    rest = kept.join(gone, "id", "left_anti")
    low = F.lower(F.concat_ws(" ", "title", F.coalesce("text", F.lit(""))))
    out = out.unionByName(rest.filter(selection.contains_none(low, relevant)).select("id", F.lit("irrelevant").alias("reason")))
    return stories.join(out, "id", "left")

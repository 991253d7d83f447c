"""Records of external catalogues as rows of one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import text as X

# Kinds of works in two catalogues and what they are here.
OPENALEX_KINDS = {"article": "article", "journal-article": "article", "book": "book", "book-chapter": "chapter", "dissertation": "thesis", "preprint": "article", "review": "article"}
CROSSREF_KINDS = {"journal-article": "article", "book-chapter": "chapter", "book": "book", "dissertation": "thesis", "proceedings-article": "article", "monograph": "book"}


def _field(df: DataFrame, path: str) -> Column:
    """A nested field, or null where the rows have no such field."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[name].dataType
    return F.col(path)


def _kind(raw: Column, known: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(raw == kv[0], kv[1]), known.items(), F.when(raw.isNull(), "other")).otherwise("other")


def _split_display(name: Column) -> tuple[Column, Column]:
    """Given and family of a display name: the last word is the family name."""
    tokens = F.split(F.coalesce(name, F.lit("")), r"\s+")
    n = F.size(tokens)
    return F.array_join(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), " "), F.element_at(tokens, -1)


def openalex_works(works: DataFrame) -> DataFrame:
    """Works of an OpenAlex-like schema: adds source_id, title, authors, doi, year, kind, pages, keywords, abstract, url.

    Missing fields give nulls; concepts count from a score over 0.3, ten at most; the abstract comes from its inverted index.
    """
    field = lambda p: _field(works, p)

    def person(a: Column) -> Column:
        given, family = _split_display(a["author"]["display_name"])
        return F.struct(given.alias("given"), family.alias("family"), F.replace(a["author"]["orcid"], F.lit("https://orcid.org/"), F.lit("")).alias("orcid"))

    doi = F.replace(field("doi"), F.lit("https://doi.org/"), F.lit(""))
    first, last = field("biblio.first_page"), field("biblio.last_page")
    good = F.slice(F.filter("concepts", lambda c: c["score"] > 0.3), F.lit(1), F.lit(10))
    return works.withColumns(
        {
            "source_id": F.concat(F.lit("openalex:"), F.replace(F.coalesce(field("id"), F.lit("")), F.lit("https://openalex.org/"), F.lit(""))),
            "title": F.coalesce(field("title"), F.lit("")),
            "authors": F.transform("authorships", person),
            "doi": doi,
            "year": F.coalesce(field("publication_year").cast("int"), F.lit(0)),
            "kind": _kind(field("type"), OPENALEX_KINDS),
            "pages": F.when(first.isNotNull() & last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first),
            "keywords": F.transform(good, lambda c: c["display_name"]),
            "abstract": F.nullif(X.from_inverted_index(F.col("abstract_inverted_index")), F.lit("")),
            "url": F.concat(F.lit("https://doi.org/"), doi),
        }
    )


def crossref_works(items: DataFrame) -> DataFrame:
    """Works of a CrossRef-like schema, to the same columns; the printed date counts before the online one and the issue's."""
    field = lambda p: _field(items, p)
    doi = field("DOI")
    dates = [F.col(f"`{d}`")["date-parts"][0][0].cast("int") for d in ("published-print", "published-online", "issued") if d in items.columns]
    person = lambda a: F.struct(F.coalesce(a["given"], F.lit("")).alias("given"), F.coalesce(a["family"], F.lit("")).alias("family"), F.regexp_replace(a["ORCID"], "https?://orcid.org/", "").alias("orcid"))
    return items.withColumns(
        {
            "source_id": F.concat(F.lit("crossref:"), F.coalesce(doi, F.lit(""))),
            "title": F.get("title", F.lit(0)),
            "authors": F.transform("author", person),
            "doi": doi,
            "year": F.coalesce(*dates, F.lit(0)),
            "kind": _kind(field("type"), CROSSREF_KINDS),
            "abstract": F.trim(F.regexp_replace(field("abstract"), "<[^>]+>", "")),
            "url": F.concat(F.lit("https://doi.org/"), doi),
        }
    )


def route(raw: Column) -> Column:
    """Which normaliser a raw record is for: datacite (JSON with attributes), eml, other xml, or unknown."""
    head = F.lower(F.ltrim(raw))
    return F.when(F.get_json_object(raw, "$.data.attributes").isNotNull(), "datacite").when(head.contains("<eml:eml") | head.contains("eml://"), "eml").when(head.startswith("<"), "xml").otherwise("unknown")

"""Citation export and renderings for readers: RIS, BibTeX, CSL-JSON, text lines, reports, sitemaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Publication types in the three formats.
RIS_TYPES = {"article": "JOUR", "thesis": "THES", "book": "BOOK", "chapter": "CHAP", "student_paper": "RPRT", "dataset": "DATA", "document": "RPRT"}
BIBTEX_TYPES = {"article": "article", "thesis": "phdthesis", "book": "book", "chapter": "incollection", "document": "techreport"}
CSL_TYPES = {"article": "article-journal", "thesis": "thesis", "book": "book", "chapter": "chapter", "student_paper": "report", "other": "article", "dataset": "dataset", "software": "software", "document": "report"}


def _mapped(value: Column, known: dict[str, str], default: str) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), known.items(), F.when(value.isNull(), default)).otherwise(default)


def ris_line(tag: str, value: Column) -> Column:
    """One tag on one line that ends in CR LF; line breaks in the value are spaces; without a value there is no line."""
    flat = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s*\r?\n\s*", " "))
    return F.when(flat == "", "").otherwise(F.concat(F.lit(f"{tag}  - "), flat, F.lit("\r\n")))


def ris_lines(tag: str, values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: ris_line(tag, v)), "")


def to_ris(kind: str = "kind", base_url: str = "https://example.org/", database: str = "Knowledge collections") -> Column:
    """An item of columns title, authors (array of names), year, journal, volume, issue, pages, doi, abstract, path, keywords as
    a RIS record."""
    pages = F.split(F.col("pages"), "[-–]")
    parts = [
        ris_line("TY", _mapped(F.col(kind), RIS_TYPES, "GEN")), ris_line("TI", F.col("title")), ris_lines("AU", F.col("authors")), ris_line("PY", F.col("year")),
        ris_line("JO", F.col("journal")), ris_line("VL", F.col("volume")), ris_line("IS", F.col("issue")), ris_line("SP", F.get(pages, F.lit(0))), ris_line("EP", F.get(pages, F.lit(1))),
        ris_line("DO", F.col("doi")), ris_line("AB", F.col("abstract")), ris_line("UR", F.concat(F.lit(base_url), F.col("path"))), ris_lines("KW", F.col("keywords")), ris_line("DB", F.lit(database)), F.lit("ER  - \r\n"),
    ]
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def bibtex_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([{}&%$#_^~\\])", r"\\$1")


def ascii_key(key: Column, fallback: Column) -> Column:
    """Only letters, digits and ``_-:.`` of a key, letters without their accents; where nothing is left, item and the fallback."""
    accented, plain = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    clean = F.regexp_replace(F.translate(key, accented, plain), r"[^a-zA-Z0-9_\-:.]", "")
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("item"), F.coalesce(fallback.cast("string"), F.lit(""))))


def to_bibtex(kind: str = "kind", base_url: str = "https://example.org/") -> Column:
    """An item as a BibTeX entry; the key is the first author's family name, the year and the first word of the title."""
    family = F.lower(F.coalesce(F.element_at(F.split(F.get("authors", F.lit(0)), r",|\s+(?=\S+$)"), 1), F.lit("unknown")))
    family = F.when(F.get("authors", F.lit(0)).contains(","), family).otherwise(F.lower(F.coalesce(F.element_at(F.split(F.get("authors", F.lit(0)), r"\s+"), -1), F.lit("unknown"))))
    word = F.regexp_replace(F.lower(F.element_at(F.split("title", r"\s+"), 1)), "[^a-z]", "")
    word = F.when(word == "", "untitled").otherwise(word)
    key = ascii_key(F.concat(family, F.coalesce(F.col("year").cast("string"), F.lit("")), word), F.col("id"))
    field = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    lines = [
        F.concat(F.lit("@"), _mapped(F.col(kind), BIBTEX_TYPES, "misc"), F.lit("{"), key), field("author", bibtex_escaped(F.array_join("authors", " and "))), field("title", bibtex_escaped(F.col("title"))),
        field("year", F.col("year").cast("string")), field("journal", bibtex_escaped(F.col("journal"))), field("volume", F.col("volume")), field("number", F.col("issue")),
        field("pages", F.replace("pages", F.lit("–"), F.lit("--"))), field("doi", F.col("doi")), field("abstract", bibtex_escaped(F.left("abstract", F.lit(1000)))), field("url", F.concat(F.lit(base_url), F.col("path"))),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}\n"))


def csl_name(display: Column) -> Column:
    """family and given of ``Smith, John`` or ``John Smith``; one word is a family name."""
    plain = F.trim(display)
    tokens = F.split(plain, r"\s+")
    inverted = F.struct(F.trim(F.split_part(plain, F.lit(","), F.lit(1))).alias("family"), F.nullif(F.trim(F.split_part(plain, F.lit(","), F.lit(2))), F.lit("")).alias("given"))
    given = F.nullif(F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), " "), F.lit(""))
    return F.when(plain.contains(","), inverted).otherwise(F.struct(F.element_at(tokens, -1).alias("family"), given.alias("given")))


def to_csl(kind: str = "kind", collection: str = "publication", base_url: str = "https://example.org/", source: str = "Knowledge collections") -> Column:
    """An item as a CSL-JSON object; fields without a value are left out."""
    year = F.when(F.col("year") > 0, F.struct(F.array(F.array("year")).alias("date-parts")))
    people = F.transform(F.filter("authors", lambda a: F.trim(a) != ""), csl_name)
    fields = {
        "id": F.concat(F.lit(f"{collection}-"), F.col("id").cast("string")), "type": _mapped(F.col(kind), CSL_TYPES, "article-journal"), "title": F.nullif("title", F.lit("")),
        "author": F.when(F.size(people) > 0, people), "issued": year, "container-title": F.nullif("journal", F.lit("")), "volume": F.nullif("volume", F.lit("")), "issue": F.nullif("issue", F.lit("")),
        "page": F.nullif(F.regexp_replace("pages", "[–—]", "-"), F.lit("")), "DOI": F.nullif("doi", F.lit("")), "URL": F.concat(F.lit(base_url), F.col("path")), "abstract": F.nullif("abstract", F.lit("")), "source": F.lit(source),
    }
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def result_line(n: Column, title: Column, kind: Column, year: Column) -> Column:
    """A search result as a line of text: number, title, kind and, where known, the year."""
    return F.concat(n.cast("string"), F.lit(". "), title, F.lit(" ["), kind, F.coalesce(F.concat(F.lit(", "), year.cast("string")), F.lit("")), F.lit("]"))


def report(groups: DataFrame, title: str, name: str, score: str, members: str, top: int) -> DataFrame:
    """A Markdown report of the first ``top`` groups by score: one row a line, ``line`` in the order of ``n``."""
    head = groups.orderBy(F.desc(score), name).limit(top)
    from pyspark.sql import Window as W

    ranked = head.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), name)))  # ``top`` rows
    lines = ranked.select(F.posexplode(F.array(F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col(name)), F.concat(F.lit("Score "), F.format_number(score, 2), F.lit(": "), F.array_join(members, ", ")))).alias("k", "line"), "rank")
    first = groups.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(f"# {title}").alias("line"))
    return first.unionByName(lines.select((F.col("rank") * 2 - 1 + F.col("k")).cast("long").alias("n"), "line"))


def sitemap(collections: dict[str, tuple[DataFrame, str, Column]], base_url: str = "https://example.org/") -> DataFrame:
    """url and updated_at of every row of several collections (frame, id column, time); a null time is left out of nothing."""
    rows = [df.select(F.concat(F.lit(f"{base_url}{name}/"), F.col(id).cast("string")).alias("url"), at.cast("date").alias("updated_at")) for name, (df, id, at) in collections.items()]
    return reduce(DataFrame.unionByName, rows)

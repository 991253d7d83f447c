"""Text functions as Columns: titles, DOIs, markup, licences, slugs, quality, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s ]+"


def normal_title(title: Column) -> Column:
    """Lower case, without tags and anything but ASCII letters, digits and single spaces."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(title, "<[^>]*>", "")), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_title(title), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct elements; two empty arrays have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def title_similarity(a: Column, b: Column) -> Column:
    """1 for titles equal after normalising (so two empty ones too), else the Jaccard similarity of their words."""
    return F.when(normal_title(a) == normal_title(b), F.lit(1.0)).otherwise(jaccard(title_words(a), title_words(b)))


def trigrams(text: Column, padded: bool = True) -> Column:
    """Distinct trigrams of every lower-case word, padded as a word index pads them; unpadded: of the whole string."""
    if not padded:
        low = F.lower(text)
        starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: low.substr(i, F.lit(3))))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def name_similarity(a: Column, b: Column) -> Column:
    return F.greatest(levenshtein_similarity(a, b), jaccard(trigrams(a, False), trigrams(b, False)))


def extract_doi(text: Column) -> Column:
    """The DOI after a resolver address, or a bare one, without closing punctuation; null where there is none."""
    linked, bare = F.regexp_extract(text, r"doi\.org/(10\.[^\s]+)", 1), F.regexp_extract(text, r"(10\.[0-9]{4,}/[^\s]+)", 1)
    found = F.when(linked != "", linked).otherwise(bare)
    return F.nullif(F.regexp_replace(found, r"[.,;)\s]+$", ""), F.lit(""))


def normal_doi(doi: Column) -> Column:
    return F.nullif(F.trim(F.lower(F.regexp_replace(doi, r"(?i)^\s*(https?://)?(dx\.)?doi\.org/", ""))), F.lit(""))


def doi_status(raw: Column) -> Column:
    """none, pending, valid or invalid; a DOI that begins ``0.`` counts as repaired."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    fixed = F.when(text.startswith("0."), F.concat(F.lit("1"), text)).otherwise(text)
    own = F.coalesce(normal_doi(fixed), F.lit(""))
    waiting = F.lower(text).isin("pending", "in review", "in press")
    status = F.when(text == "", "none").when(waiting, "pending").when(own.rlike(r"^10\.[0-9]{4,}/\S+$"), "valid").otherwise("invalid")
    return F.struct(F.when(status == "valid", own).alias("doi"), status.alias("status"))


def strip_html(html: Column) -> Column:
    """Text without tags; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), SPACES, " ")), F.lit(""))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&amp;", "&"))


def article_text(html: Column) -> Column:
    """The body of an article as text: paragraphs end in a blank line, entities are resolved, scripts and styles go."""
    body = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(body == "", html).otherwise(body)
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?i)<br\s*/?>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, "(?i)</p>", "\n\n"), "<[^>]*>", "")
    body = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, body)
    return F.trim(F.regexp_replace(F.regexp_replace(body, "[ \t]+", " "), "\n{3,}", "\n\n"))


def byline(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\bBy ([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-zA-Z'-]+)", 1), F.lit(""))


LICENCES = (("cc0", "CC0-1.0"), ("public domain", "CC0-1.0"), ("by-nc-nd", "CC-BY-NC-ND"), ("by-nc-sa", "CC-BY-NC-SA"), ("by-nc", "CC-BY-NC"), ("by-sa", "CC-BY-SA"), ("by-nd", "CC-BY-ND"), ("cc by", "CC-BY"), ("cc-by", "CC-BY"), ("creativecommons.org/licenses/by/", "CC-BY"), ("apache", "Apache-2.0"), ("mit license", "MIT"), ("open government", "OGL"))


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], default: str | None) -> Column:
    """The value of the first rule whose words the text contains, in any case."""
    low = F.lower(text)
    found = reduce(lambda c, r: c.when(low.contains(r[0]), r[1]), rules[1:], F.when(low.contains(rules[0][0]), rules[0][1]))
    return found.otherwise(F.lit(default).cast("string"))


def licence(raw: Column) -> Column:
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.lit(None).cast("string")).otherwise(first_rule(raw, LICENCES, "other"))


def slug(text: Column, most: int = 80) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.left(made, F.lit(most)), "-+$", "")


def quality_score(text: Column, pages: Column | int = 1) -> Column:
    """1 less penalties: few characters a page, few real words, replacement characters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    real = F.size(F.filter(words, lambda w: w.rlike("^[A-Za-z]{2,}[.,;:!?]?$"))) / F.greatest(F.lit(1), F.size(words))
    broken = F.length(F.regexp_replace(text, "[^�]", ""))
    per_page = F.length(text) / F.greatest(F.lit(1), F.lit(pages) if isinstance(pages, int) else pages)
    score = 1 - F.when(per_page < 200, 0.4).otherwise(0) - F.when(real < 0.5, 0.4).when(real < 0.7, 0.2).otherwise(0) - F.least(F.lit(0.3), broken / 100)
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score))


def citation_label(names: Column) -> Column:
    """A, A & B, or A et al."""
    n = F.size(names)
    return F.when(n == 0, F.lit(None).cast("string")).when(n == 1, F.get(names, 0)).when(n == 2, F.concat_ws(" & ", F.get(names, 0), F.get(names, 1))).otherwise(F.concat(F.get(names, 0), F.lit(" et al.")))


def first_year(text: Column) -> Column:
    """The first year from 1900 to 2029, as the first day of it."""
    year = F.regexp_extract(text, r"\b(19[0-9]{2}|20[0-2][0-9])\b", 1)
    return F.when(year != "", F.concat(year, F.lit("-01-01")))


def sanitised(text: Column, most: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")), F.lit(most))


def from_inverted_index(index: Column) -> Column:
    """map<word, positions> to the text it was made of."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda s: s["w"]), " ")


def xml_text(xml: Column, tag: str) -> Column:
    """The text of the first element of that name, without inner tags."""
    return strip_html(F.regexp_extract(xml, rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1))


def xml_texts(xml: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), 1), strip_html)


def chunks(text: Column, size: int = 12_000, overlap: int = 500) -> Column:
    """Overlapping windows of a text; the last begins where it still adds something new."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int")))
    return F.transform(starts, lambda k: text.substr(k * step + 1, F.lit(size)))


def tolerant_json(text: Column) -> Column:
    """The outermost object of a text that may fence it or talk around it."""
    plain = F.regexp_replace(text, r"(?s)^.*?```(?:json)?|```.*$", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))


def valid_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+")


def valid_orcid(c: Column) -> Column:
    return c.rlike(r"^(https?://orcid\.org/)?\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def parsed_date(text: Column) -> Column:
    """A date written as ``2024-01-31``, ``January 31, 2024`` or ``31 January 2024``; null for anything else."""
    plain = F.trim(text)
    formats = ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in formats))


def parsed_year(text: Column) -> Column:
    """The first four digits in a row, where they are a year from 1600 to 2100."""
    year = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    return F.when(year.between(1600, 2100), year)


def place_name(raw: Column) -> Column:
    """A place's name to compare by: lower case, without leading articles and ``near``, closing country or state, and signs."""
    low = F.trim(F.lower(raw))
    bare = F.regexp_replace(F.regexp_replace(low, r"^(the|near|upper part of) ", ""), r",\s*(usa|u\.s\.a\.|united states|[a-z]{2})$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def camel(snake: Column) -> Column:
    """snake_case to camelCase."""
    words = F.split(snake, "_")
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.get(words, F.lit(0)), F.array_join(F.transform(rest, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""))


def embedding_text(title: Column, abstract: Column, body: Column, words: int = 500, most: int = 32_000) -> Column:
    """Title and abstract, or title and the first words of the body, cut to a length."""
    start = F.array_join(F.slice(F.split(flattened(body), " "), F.lit(1), F.lit(words)), " ")
    return F.left(F.concat(title, F.lit(". "), F.coalesce(abstract, start)), F.lit(most))


def keywords(text: Column) -> Column:
    """The non-empty parts between commas and semicolons."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda w: w != "")


def flattened(text: Column) -> Column:
    """One line: white space of any kind is single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

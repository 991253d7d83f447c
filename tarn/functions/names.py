"""Person names: splitting author strings, creators and editors, initials, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(given: Column, family: Column) -> Column:
    return F.struct(given.alias("given"), family.alias("family"))


def _joined(tokens: Column, start: int, length: Column) -> Column:
    return F.array_join(F.slice(tokens, F.lit(start), length), " ")


def _dotted(letters: Column) -> Column:
    """JA becomes J. A."""
    return F.rtrim(F.regexp_replace(letters, "(.)", "$1. "))


def parse_author(raw: Column) -> Column:
    """One author of a list, as given and family: ``de Boer G`` (initials last), ``John Smith`` or ``Smith``; student marks go."""
    tokens = F.split(F.trim(F.regexp_replace(raw, r"\*", "")), r"\s+")
    n, last = F.size(tokens), F.element_at(tokens, -1)
    alone = _named(F.lit(""), F.get(tokens, F.lit(0)))
    initials_last = _named(_dotted(last), _joined(tokens, 1, F.greatest(n - 1, F.lit(0))))
    given_first = _named(F.get(tokens, F.lit(0)), _joined(tokens, 2, F.greatest(n - 1, F.lit(0))))
    return F.when(n == 1, alone).when(last.rlike("^[A-Z]{1,5}$"), initials_last).otherwise(given_first)


def parse_authors(raw: Column) -> Column:
    """``Smith JA, de Boer G*, et al.`` to an array of given and family."""
    plain = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i),?\s*et al\.?\s*$", ""))
    return F.transform(F.filter(F.transform(F.split(plain, ","), lambda p: F.trim(p)), lambda p: p != ""), parse_author)


def parse_creator(raw: Column) -> Column:
    """``Smith, John A.`` or ``John A. Smith``; a name of one word is a family name."""
    plain = F.trim(raw)
    comma = F.instr(plain, ",")
    tokens = F.split(plain, r"\s+")
    n = F.size(tokens)
    inverted = _named(F.trim(F.substr(plain, comma + 1)), F.trim(F.left(plain, comma - 1)))
    return F.when(comma > 0, inverted).otherwise(_named(_joined(tokens, 1, F.greatest(n - 1, F.lit(0))), F.element_at(tokens, -1)))


def expand_initials(given: Column) -> Column:
    """J and JA get dots; names with dots and other names stay."""
    compact = (~given.contains(".")) & given.rlike("^(.|[A-Z]{2,5})$")
    return F.when(given.isNull(), "").when(compact, _dotted(given)).otherwise(given)


def display_name(given: Column, family: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) == "", family).otherwise(F.trim(F.concat(expand_initials(given), F.lit(" "), family)))


def parse_editors(raw: Column) -> Column:
    """``J. E. Moran, Smith JA and Lee`` to an array of given and family; initials may come first or last."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r",\s*(?:and\s+)?|;\s*|\s+and\s+"), lambda p: F.trim(p) != "")

    def one(part: Column) -> Column:
        first = F.regexp_extract(F.trim(part), r"^((?:[A-Z]\.?\s+)+)(\S.*)$", 1)
        rest = F.regexp_extract(F.trim(part), r"^((?:[A-Z]\.?\s+)+)(\S.*)$", 2)
        return F.when(first != "", _named(F.trim(first), rest)).otherwise(parse_author(part))

    return F.transform(parts, one)


def family_name(full: Column) -> Column:
    """The last word of a full name."""
    return F.element_at(F.split(F.trim(full), r"\s+"), -1)


def normal_name(name: Column) -> Column:
    """Lower case, without ``.,'"``, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[.,'\"]", ""), r"\s+", " "))


def author_key(family: Column, given: Column) -> Column:
    """Family name and the first initial, normalised."""
    return F.concat_ws("|", normal_name(family), F.left(normal_name(given), F.lit(1)))


def initials(given: Column) -> Column:
    """The first letters of a given name's parts, in order."""
    parts = F.filter(F.split(F.upper(F.coalesce(given, F.lit(""))), r"[\s.]+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.left(p, F.lit(1)))


def signature(given: Column) -> Column:
    """All initials as one text; what a full name has in common with its initials."""
    return F.array_join(initials(given), "")


def initials_match(a: Column, b: Column) -> Column:
    """Whether all positions that both have agree; with one initial on either side the first decides; none matches nothing."""
    x, y = initials(a), initials(b)
    n = F.least(F.size(x), F.size(y))
    same = F.forall(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q), lambda z: z)
    return F.when(n == 0, F.lit(False)).otherwise(same)


def same_author(a: Column, b: Column) -> Column:
    """Whether two given names beside one family name may be one person's: initials agree, and where both are longer than
    initials one is the beginning of the other."""
    short = lambda g: F.length(F.regexp_replace(g, r"[.\s]", "")) <= 4
    low_a, low_b = F.lower(a), F.lower(b)
    return initials_match(a, b) & (short(a) | short(b) | low_a.startswith(low_b) | low_b.startswith(low_a))

"""The English stemmer of the Snowball family (Porter's second algorithm), for one word."""

from __future__ import annotations

import re

# Fixed values of the published algorithm: forms of their own, words that are left as they are after the first step, prefixes
# behind which the first region begins, and what the endings of steps 2 to 4 become.
FORMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in FORMS:
        return FORMS[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    front = next((p for p in PREFIXES if word.startswith(p)), None)
    found = _REGION.search(word)
    r1 = len(front) if front else found.end() if found else len(word)
    found = _REGION.search(word, r1)
    r2 = found.end() if found else len(word)

    word = word.removesuffix("'").removesuffix("'s")
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in SETTLED:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        word = rest + "ee" if len(rest) >= r1 else word
    elif ending and _VOWEL.search(rest):
        if rest.endswith(("at", "bl", "iz")):
            word = rest + "e"
        elif rest.endswith(DOUBLES):
            word = rest[:-1]
        else:
            word = rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, STEP_2)
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= r1 and (ending != "ogi" or rest.endswith("l")) and (ending != "li" or rest[-1:] in tuple(BEFORE_LI)):
        word = rest + STEP_2[ending]
    ending = _longest(word, STEP_3)
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= (r2 if ending == "ative" else r1):
        word = rest + STEP_3[ending]
    ending = _longest(word, STEP_4)
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= r2 and (ending != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        if len(word) > r2 or (len(word) > r1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _case(c: str, forms: dict[str, str], other: str) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in forms.items())} ELSE {other} END"


def _ends(c: str, endings) -> str:
    """The longest of the endings that the string has, or '' (the match that begins first is the longest)."""
    return f"regexp_extract({c}, '({'|'.join(endings)})$')"


def stem_sql(words: str) -> str:
    """SQL (DuckDB) for (word, term) of a query of lower-case words of letters and digits (column ``word``, each once): the steps of
    ``stem`` one select after another.  ``w``: the word so far; ``f``: 1 if it is done; ``r1`` and ``r2``: where its regions begin."""
    vowel, short = f"'{_VOWEL.pattern}'", f"'{_SHORT.pattern}'"
    end = f"'^.*?{_REGION.pattern}'"
    rest = "left(w, length(w) - length(e))"
    layers = [
        f"SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE {_case('word', FORMS, """regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g')""")} END AS w, (length(word) <= 2 OR word IN ({', '.join(f"'{k}'" for k in FORMS)}))::INT AS f FROM ({words})",
        f"SELECT *, CASE {' '.join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in PREFIXES)} WHEN regexp_matches(w, {end}) THEN length(regexp_extract(w, {end})) ELSE length(w) END AS r1",
        f"SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), {end}) THEN r1 + length(regexp_extract(substr(w, r1 + 1), {end})) ELSE length(w) END AS r2",
        f"""SELECT * REPLACE (CASE WHEN f = 1 THEN w WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
            WHEN ends_with(w, 's') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'ss') AND regexp_matches(left(w, length(w) - 2), {vowel}) THEN left(w, length(w) - 1) ELSE w END AS w)""",
        f"SELECT * REPLACE (CASE WHEN w IN ({', '.join(f"'{k}'" for k in sorted(SETTLED))}) THEN 1 ELSE f END AS f), {_ends('w', ('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'))} AS e",
        f"SELECT *, {rest} AS r",
        f"""SELECT * REPLACE (CASE WHEN f = 1 OR e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(r) >= r1 THEN r || 'ee' ELSE w END WHEN NOT regexp_matches(r, {vowel}) THEN w
            WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN regexp_matches(r, '({'|'.join(DOUBLES)})$') THEN left(r, length(r) - 1) WHEN length(r) <= r1 AND regexp_matches(r, {short}) THEN r || 'e' ELSE r END AS w)""",
        "SELECT * REPLACE (CASE WHEN f = 0 AND length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w)",
        f"SELECT * REPLACE ({_ends('w', sorted(STEP_2, key=len, reverse=True))} AS e)",
        f"SELECT * REPLACE ({rest} AS r)",
        f"SELECT * REPLACE (CASE WHEN f = 0 AND e <> '' AND length(r) >= r1 AND (e <> 'ogi' OR ends_with(r, 'l')) AND (e <> 'li' OR regexp_matches(r, '[{BEFORE_LI}]$')) THEN r || {_case('e', STEP_2, """''""")} ELSE w END AS w)",
        f"SELECT * REPLACE ({_ends('w', sorted(STEP_3, key=len, reverse=True))} AS e)",
        f"SELECT * REPLACE ({rest} AS r)",
        f"SELECT * REPLACE (CASE WHEN f = 0 AND e <> '' AND length(r) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN r || {_case('e', STEP_3, """''""")} ELSE w END AS w)",
        f"SELECT * REPLACE ({_ends('w', sorted(STEP_4, key=len, reverse=True))} AS e)",
        f"SELECT * REPLACE ({rest} AS r)",
        "SELECT * REPLACE (CASE WHEN f = 0 AND e <> '' AND length(r) >= r2 AND (e <> 'ion' OR regexp_matches(r, '[st]$')) THEN r ELSE w END AS w)",
        f"""SELECT word, replace(CASE WHEN f = 1 THEN w WHEN ends_with(w, 'e') THEN CASE WHEN length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(left(w, length(w) - 1), {short})) THEN left(w, length(w) - 1) ELSE w END
            WHEN ends_with(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS term""",
    ]
    sql = layers[0]
    for layer in layers[1:]:
        sql = f"{layer} FROM ({sql})"
    return sql

"""Entity resolution: similarity joins, staged matching, duplicate removal."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators.storage import stored


SHORT = 24  # sets up to this size meet by pairs of tokens, larger ones by single tokens
SIZED = 0.7  # similarity from which pairs of tokens are keys for certain sizes only
SIZED_SHORT = 32  # and sets up to this size meet by them
COUNTS = 1 << 17  # numbers in which the frequencies of all tokens are kept
FEW = 50_000  # rows that go whole to every task


def _overlap(t: float, n: Column, m: Column) -> Column:
    """Tokens that sets of n and m share at least when their Jaccard similarity is t or more."""
    return F.greatest(F.ceil((n + m) * (t / (1 + t)) - 1e-9), F.lit(1)).cast("int")


def _members(df: DataFrame, tokens: Column, *more: str) -> DataFrame:
    """Rows with the token set that they have (sid, tokens); both are null for null and empty sets.  Read from the shared folder
    from here on, so that the texts are worked once, and dealt, so that large row groups of a file are no large tasks."""
    kept = F.when(F.size("tokens") > 0, F.col("tokens"))
    plain = df.repartition(F.xxhash64("id")).select("id", *more, F.sort_array(tokens).alias("tokens")).withColumn("tokens", kept)
    return stored(plain.withColumn("sid", F.unhex(F.md5(F.to_json("tokens")))), "token-sets")


def _distinct_sets(left: DataFrame, right: DataFrame, tokens: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``_ordered_sets`` of two sides (id, tokens), and the members of either (sid, id).  One frame with itself is worked once.
    ``tokens``: what to make the tokens of, after the rows are dealt."""
    own = _members(left, F.col("tokens") if tokens is None else tokens)
    other = own if right is left else _members(right, F.col("tokens") if tokens is None else tokens)
    return _ordered_sets(own, other), *(m.filter("sid is not null").select("sid", "id") for m in (own, other))


def _ordered_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of the members of two sides each different token set once: sid and a number, tokens from rare to common, n, l and r (which
    sides have it), and sig: a bit for each token by its hash, turned by every token that has it, so that two sets differ in no
    fewer tokens than their sigs in bits."""
    sides = [m.filter("sid is not null").select("sid", F.array_compact("tokens").alias("tokens"), F.lit(k == 0 or right is left).alias("l"), F.lit(k == 1 or right is left).alias("r")) for k, m in enumerate((left, right))]
    both = sides[0] if right is left else sides[0].unionByName(sides[1])
    sets = stored(both.groupBy("sid", "tokens").agg(F.max("l").alias("l"), F.max("r").alias("r")).filter(F.size("tokens") > 0), "token-sets")
    ordered = F.transform(F.sort_array(F.arrays_zip(_frequencies(sets).alias("f"), F.col("tokens").alias("token"))), lambda s: s["token"])
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    sig = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))
    return stored(sets.select("sid", F.monotonically_increasing_id().alias("no"), "l", "r", ordered.alias("tokens"), F.size("tokens").alias("n"), sig.alias("sig")), "ordered-sets")


def _frequencies(sets: DataFrame) -> Column:
    """Of each of a set's tokens about how many sets have it.  Tokens are counted by their hash in COUNTS numbers, so neither the sets
    are shuffled for it nor does what a task holds grow with the tokens.  Tokens that share a number count as more frequent than they
    are, which makes more candidates but loses none: any order of tokens would do, if it is the same in all sets."""
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(COUNTS)).cast("int")
    counted = sets.select(F.explode("tokens").alias("t")).groupBy(spot(F.col("t")).alias("k")).count().toArrow()
    known = np.zeros(COUNTS, np.int64)
    known[counted["k"].to_numpy()] = counted["count"].to_numpy()
    counts = sets.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<bigint>")
    def frequencies(spots: pa.Array) -> pa.Array:
        ends = np.cumsum(spots.value_lengths().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(counts.value[spots.flatten().to_numpy()]))

    return frequencies(F.transform("tokens", spot))


def _rules(sizes: dict[int, int], t: float) -> list[tuple[int, int, int, int, int]]:
    """(n, own, other, shared, head): by how many of its tokens a set of n is found (shared), of which first ones (head), and which
    class it has and which class of sets it so finds.  ``sizes``: how many sets of each size there are.

    Below SIZED all are one class (0).  From there on a class is a size, -1 the sizes up to SIZED_SHORT that few sets have, and -2
    the larger ones; sets of sizes that many have meet by two tokens, others by one.
    """
    least = {n: max(math.ceil(n * t - 1e-9), 1) for n in sizes}
    need = lambda n, m: max(math.ceil((n + m) * (t / (1 + t)) - 1e-9), 1)
    if t < SIZED:
        single = [(n, 0, 0, 1, n - k + 1) for n, k in least.items() if n > t * SHORT - 1e-9 or need(n, k) == 1]
        return single + [(n, 0, 0, 2, min(n, n - k + 2)) for n, k in least.items() if 1 < n <= SHORT]
    rare = min(sum(sizes.values()) // 1000, 1000)
    of = {n: -2 if n > SIZED_SHORT else -1 if count <= rare else n for n, count in sizes.items()}
    heads: dict[tuple[int, int, int, int], int] = {}
    for n in sizes:
        low = least[n] if n <= SIZED_SHORT / t + 1 else SIZED_SHORT + 1
        short = [m for m in range(low, SIZED_SHORT + 1) if m in sizes and min(n, m) >= t * max(n, m) - 1e-9]
        longest = max(least[n], SIZED_SHORT + 1)  # of the larger sets the smallest, which needs the fewest common tokens
        for m in short + ([longest] if -2 in of.values() and min(n, longest) >= t * max(n, longest) - 1e-9 else []):
            other = of.get(m, -2) if m <= SIZED_SHORT else -2
            shared = 2 if min(of[n], other) > 0 and need(n, m) > 1 else 1
            key = (n, of[n], other, shared)
            heads[key] = max(heads.get(key, 0), min(n, n - need(n, m) + shared))
    return [(*key, head) for key, head in heads.items()]


def _keyed(sets: DataFrame, t: float, rules: list[tuple[int, int, int, int, int]] | None = None) -> DataFrame:
    """(key, no, l, r, n, sig, at, shared, own, other): what a set can be found by, the place of the key's last token, how many tokens
    the key has, and the classes of this and of the other set (``_rules``).

    Two sets that share o tokens or more, ordered alike, have their first k common tokens among the first n - o + k of each.
    Short sets meet by their first two common tokens: such pairs are far rarer than the tokens, so frequent tokens make few
    candidates.  Pairs that need to share only one token, and those with a larger set, meet by the first.

    Tokens before a key's last one that are not in it are not shared, so a key at a later place is of use for few sizes of the other
    set or for none.  From SIZED on these sizes are few, and sets meet by key and sizes, of the sizes that there are: two frequent
    tokens that come after a rare one are then no key of all the sets that have them.
    """
    rules = _rules(_sizes(sets), t) if rules is None else rules
    table = sets.sparkSession.createDataFrame(rules, "n int, own int, other int, shared int, head int")
    asked = sets.join(F.broadcast(table), "n").select("no", "l", "r", "n", "sig", "own", "other", "shared", F.transform(F.slice("tokens", F.lit(1), F.col("head")), lambda x: F.xxhash64(x)).alias("h"))
    place = lambda key, i: F.struct(key.alias("key"), (i + 1).cast("int").alias("at"))
    later = lambda x, i: F.transform(F.slice("h", F.lit(1), i.cast("int")), lambda y: place(F.xxhash64(y, x), i))
    keys = F.when(F.col("shared") == 1, F.transform("h", place)).otherwise(F.flatten(F.transform("h", later)))
    return asked.select("no", "l", "r", "n", "sig", "own", "other", "shared", F.inline(keys))


def _sizes(sets: DataFrame) -> dict[int, int]:
    return {r.n: r["count"] for r in sets.groupBy("n").count().collect()}


def candidate_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of the numbers of different sets, x of the left and y of the right, that can reach the threshold: size, place of the
    first common tokens, bits in which their sigs differ.  Each pair comes once, also where both sets are on both sides.  Keys of
    the left meet keys of the right only: those that many sets of one side have make no rows among themselves.

    Where the right's keys are few, they go to the left's, which are then not shuffled.
    """
    known = sets.filter("r")
    few = known.count() <= FEW
    rules = _rules(_sizes(sets), threshold)
    right = _keyed(known, threshold, rules)
    right = stored(right, "set-keys") if few else right
    left = _keyed(sets.filter("l"), threshold, rules)
    turned = {"x": ("own", "other"), "y": ("other", "own")}
    x, y = (df.select(F.xxhash64("key", "shared", *turned[k]).alias("key"), "shared", *(F.col(c).alias(f"{c}{k}") for c in ("no", "l", "r", "n", "at", "sig"))) for k, df in (("x", left), ("y", right)))
    need = _overlap(threshold, F.col("nx"), F.col("ny"))
    two = (F.greatest("nx", "ny") <= SHORT) & (need >= 2)
    once = F.lit(True) if threshold >= SIZED else two == (F.col("shared") == 2)
    reach = F.col("shared") + F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= need
    alike = F.bit_count(F.col("sigx").bitwiseXOR(F.col("sigy"))) <= F.col("nx") + F.col("ny") - 2 * need
    sized = F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9
    other = (F.col("nox") < F.col("noy")) | ((F.col("nox") != F.col("noy")) & ~(F.col("rx") & F.col("ly")))
    met = x.join(_sent(y) if few else y, ["key", "shared"]).filter(other & sized & alike & reach & once)
    return met.select(F.col("nox").alias("x"), F.col("noy").alias("y")).distinct()


def _sent(df: DataFrame) -> DataFrame:
    """A stored table of up to FEW rows goes whole to every task of the other side."""
    return F.broadcast(df) if df.count() <= FEW else df


def similar_sets(sets: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """(left_sid, right_sid, similarity) of sets of the two sides, equal sets included."""
    side = lambda k, of: sets.filter(of).select(F.col("no").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("sid", "tokens", "l", "r")))
    met = _sent(stored(candidate_sets(sets, threshold), "set-pairs"))
    both = met.join(side("x", "l"), "x").join(_sent(side("y", "r")), "y")
    scored = both.withColumn("similarity", X.jaccard(F.col("tokensx"), F.col("tokensy"))).filter(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)
    turned = F.array(*(F.struct(F.col(f"sid{a}").alias("left_sid"), F.col(f"sid{b}").alias("right_sid"), (F.col(f"l{a}") & F.col(f"r{b}")).alias("ok")) for a, b in ("xy", "yx")))
    near = scored.select(F.inline(turned), "similarity").filter("ok").drop("ok")
    same = sets.filter("l and r").select(F.col("sid").alias("left_sid"), F.col("sid").alias("right_sid"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same) if threshold < 1 or not strict else near


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float, strict: bool = True, tokens: Column | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs whose token sets have a Jaccard similarity over the threshold.

    Both sides have id and tokens (an array of distinct tokens), or what ``tokens`` makes them of; null and empty sets are similar to none.  Equal sets are worked
    once, whatever the number of rows that have them; only the pairs that come out are spread over those rows.  No pair is lost.
    """
    sets, own, other = _distinct_sets(left, right, tokens)
    found = similar_sets(sets, threshold, strict)
    of = lambda df, name: df.select(F.col("sid").alias(f"{name}_sid"), F.col("id").alias(f"{name}_id"))
    return found.join(of(own, "left"), "left_sid").join(of(other, "right"), "right_sid").select("left_id", "right_id", "similarity")


def title_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Title similarity over the threshold between two frames (id, title); titles equal after normalising have 1, also two that
    have no word."""
    blank = lambda df: stored(df.filter(X.normal_title(F.col("title")) == "").select("id"), "blank-titles")
    bare = blank(left)
    others = bare if right is left else blank(right)
    same = bare.select(F.col("id").alias("left_id")).crossJoin(others.select(F.col("id").alias("right_id"))).withColumn("similarity", F.lit(1.0))
    return set_similarity_join(left, right, threshold, tokens=X.title_words(F.col("title"))).unionByName(same)


def with_group(df: DataFrame, *more: str) -> DataFrame:
    """Adds ``_g``, the same for rows whose titles are equal after normalising and that agree in ``more``, nulls included."""
    return df.withColumn("_g", F.to_json(F.struct(X.normal_title(F.col("title")).alias("title"), *more)))


def group_pairs(left: DataFrame, right: DataFrame, threshold: float, *more: str) -> DataFrame:
    """Title similarity over the threshold between groups of ``with_group``: (left_g, right_g, similarity, and each of ``more`` with
    _l and _r), so that rows with one title are not paired one by one."""
    sides = []
    for df, k in ((left, "l"), (right, "r")):
        sides.append(df.groupBy("_g").agg(F.min("title").alias("title"), *(F.min(c).alias(f"{c}_{k}") for c in more)))
    pairs = title_pairs(*(s.select(F.col("_g").alias("id"), "title") for s in sides), threshold).withColumnsRenamed({"left_id": "left_g", "right_id": "right_g"})
    for s, name in zip(sides, ("left_g", "right_g"), strict=True):
        pairs = pairs.join(s.drop("title").withColumnRenamed("_g", name), name) if more else pairs
    return pairs


def match_records(records: DataFrame, candidates: DataFrame, years: int = 1) -> DataFrame:
    """Records (id, doi, title, year) against candidates of the same columns: one row a record, with match and confidence.

    In order: equal DOI (exact); title over 0.9 with years at most ``years`` apart or unknown (high over 0.95, else fuzzy),
    the best one; title over 0.95 whatever the year (fuzzy).  Null keys match nothing; ties go to the least candidate.
    Titles are similar by their sets of words, so sets are matched, and of a set only the years that its rows have.
    """
    keyed = lambda df: _members(df.withColumn("k", X.normal_doi(F.col("doi"))), X.title_words(F.col("title")), "k", "year")
    asked, known = keyed(records), keyed(candidates)
    first = known.filter("k is not null").groupBy("k").agg(F.min("id").alias("exact_id"))
    exact = asked.filter("k is not null").join(first, "k").select("id", "exact_id")
    side = lambda df, name: df.filter("sid is not null").groupBy(F.col("sid").alias(f"{name}_sid"), F.col("year").alias(f"{name}_year"))
    near = F.coalesce(F.abs(F.col("left_year") - F.col("right_year")) <= years, F.lit(True))
    pairs = similar_sets(_ordered_sets(asked, known), 0.9).join(side(asked, "left").agg(F.lit(1).alias("_one")), "left_sid")
    named = pairs.join(side(known, "right").agg(F.min("id").alias("match_id")), "right_sid")
    tiered = named.withColumn("tier", F.when(near, 2).when(F.col("similarity") > 0.95, 3)).filter("tier is not null")
    chosen = tiered.groupBy("left_sid", "left_year").agg(F.min_by(F.struct("match_id", "tier", "similarity"), F.struct("tier", -F.col("similarity"), "match_id")).alias("b"))
    titled = asked.filter("sid is not null").join(chosen, (F.col("sid") == F.col("left_sid")) & F.col("year").eqNullSafe(F.col("left_year"))).select("id", "b")
    best = asked.select("id").join(exact, "id", "left").join(titled, "id", "left")
    by_doi = F.col("exact_id").isNotNull()
    confidence = F.when(by_doi, "exact").when((F.col("b.tier") == 2) & (F.col("b.similarity") > 0.95), "high").when(F.col("b").isNotNull(), "fuzzy").otherwise("none")
    similarity = F.when(by_doi, F.lit(1.0)).otherwise(F.round("b.similarity", 6))
    return best.select("id", F.coalesce("exact_id", "b.match_id").alias("match_id"), confidence.alias("confidence"), similarity.alias("similarity"))


def new_records(records: DataFrame, existing: DataFrame, threshold: float = 0.85, years: int = 2) -> DataFrame:
    """The records that match no existing one by DOI, nor by title over the threshold with years close or unknown."""
    doi = existing.select(X.normal_doi(F.col("doi")).alias("_k")).filter("_k is not null").distinct()
    left = with_group(records.withColumn("_k", X.normal_doi(F.col("doi"))).join(doi, "_k", "left_anti").drop("_k"), "year")
    near = F.coalesce(F.abs(F.col("year_l") - F.col("year_r")) <= years, F.lit(True))
    hit = group_pairs(left, with_group(existing, "year"), threshold, "year").filter(near).select(F.col("left_g").alias("_g")).distinct()
    return left.join(hit, "_g", "left_anti").select(*records.columns)


def distinct_by(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row for each key, the first in order; rows with a null key all stay."""
    keyed = df.withColumn("_k", key)
    rank = F.row_number().over(W.partitionBy("_k").orderBy(*order))
    return keyed.withColumn("_rn", rank).filter("_rn = 1 or _k is null").drop("_k", "_rn")


def coverage_by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, of each key those of the first source that has it (first wins by priority)."""
    out = None
    for k, df in enumerate(sources):
        tagged = df.withColumn("_p", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    rank = F.row_number().over(W.partitionBy(key).orderBy("_p"))
    return out.withColumn("_rn", rank).filter("_rn = 1").drop("_p", "_rn")

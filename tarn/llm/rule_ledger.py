"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one failure bit per rule beside the measurements.  A policy
is a versioned mask over those bits, so applying another policy, or asking what a policy would lose without one of its
rules, needs the ledger alone and never the texts again.

Defined results: a null text counts as empty (no words: the ``short`` rule fails); repeated rows get one ledger row
each; an empty table gives an empty ledger; the columns of the input named in ``keep`` pass through unchanged and must not
be named like a measurement, any other column is left out; ``filter_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.text_stats import measures
from tarn.llm.textarrays import slices, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements; ``bit`` never changes once a ledger has been stored."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[name] for name in self.rules)


RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeats", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("line_copies", 3, "100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", 4, "n_upper > n_lower"),
    Rule("word_length", 5, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
BASE = Policy("base", ("short", "repeats"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", ("short", "repeats", "symbols", "line_copies")), Policy("v2", tuple(r.name for r in RULES)))}


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row of measurements for each document, with the ``keep`` columns."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = measures(text_of(part["_text"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*keep, *MEASURES])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit b is set where the rule with that bit fails."""
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules))
    return measured(docs, keep, text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``policy_version`` and ``kept``: whether no rule of the policy fails."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)))
    return entries.withColumns({"policy_version": F.lit(policy.version), "kept": failed == 0})


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, those that only it fails, and what the policy keeps without it.

    The ledger is first counted by its masked bits, at most 2^rules rows, so the rest is independent of its size.
    """
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in rules if r.name in policy.rules))
    hit = F.col("bits").bitwiseAND(F.col("flag")) != 0
    alone = F.col("bits") == F.col("flag")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return (
        patterns.select("bits", "n", F.inline(names))
        .groupBy("rule")
        .agg(total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"), total(alone | (F.col("bits") == 0)).alias("n_kept_without"))
        .withColumn("policy_version", F.lit(policy.version))
    )


def filter_documents(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns; texts are read once and never shuffled."""
    own = [f"_{k}_" for k in range(len(docs.columns))]  # any of them may be named like a measurement
    entries = apply_policy(ledger(docs.toDF(*own), rules, tuple(own), own[docs.columns.index(text)]), policy, rules)
    return entries.filter("kept").select(*own).toDF(*docs.columns)

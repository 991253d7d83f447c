"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.  ``run`` writes what a stage
returns to the shared folder and reads it again for the next one.

Defined results, for every stage: a null text is the empty text (too short for the quality rules, so it goes there); rows that
repeat a key and a text are one class, of which one row stays after the near-duplicate stage; of a class the least key stays, a
null key last; a key with several texts loses only those that are copies; further columns pass through all stages but the last,
whatever their names; an empty table stays empty, and the last stage then gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe_chunks, decontaminate, jaccard_join, rule_ledger, secret_cnn
from tarn.llm.storage import stored

#: Near-duplicate classes need rounds over the whole table; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return rule_ledger.filter_documents(docs, rule_ledger.POLICIES["v2"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays."""
    return jaccard_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_cnn.redact(docs, secret_cnn.train(secret_cnn.labelled_findings(docs) + secret_cnn.made_findings()))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests, and the token ids."""
    return bpe_chunks.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe_chunks, chat_parts, decontaminate, filter_audit, hilbert_shards, jaccard_join, piece_offsets, quality_gbt, rule_ledger, secret_cnn, token_files, toxicity_segments, whitening
from tarn.llm.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_chunks.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored(rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "rule-ledger")
    base = rule_ledger.BASE.mask(rule_ledger.RULES)
    judged = rule_ledger.apply_policy(entries, rule_ledger.POLICIES["v2"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(base)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    parts = turns.unionByName(probe).select("conv_id", "turn", "role", chat_parts.text_parts().alias("parts"))
    return chat_parts.read_back(chat_parts.format_turns(parts))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_blocks(blocks).withColumnRenamed("key", "doc_id")


def op7_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_segments.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_segments.score(docs, model).drop("passages")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = hilbert_shards.shard(docs, "doc_id", ["source", "n_chars", "lang"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def op9_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = secret_cnn.train(secret_cnn.labelled_findings(docs) + secret_cnn.made_findings())
    return secret_cnn.scan(docs, net).drop("found")


def op10_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbt.score(docs, quality_gbt.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_offsets.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe_chunk_reuse": op2_bpe_chunk_reuse,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_rule_ledger": op4_rule_ledger,
    "op5_chat_parts": op5_chat_parts,
    "op6_token_files": op6_token_files,
    "op7_toxicity_segments": op7_toxicity_segments,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_secret_cnn": op9_secret_cnn,
    "op10_quality_gbt": op10_quality_gbt,
    "op11_filter_audit": op11_filter_audit,
    "op12_piece_offsets": op12_piece_offsets,
    "op13_jacobi_whitening": op13_jacobi_whitening,
}

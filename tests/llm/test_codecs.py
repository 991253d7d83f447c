"""BPE chunk reuse, token files and the range coder: held against the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import bpe_chunks, queries, range_coder, token_files

SF = "/root/testdata/sf0.001"
BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = ["", "<|endoftext|>" * 50, " " * 3000, "ab " * 2000, "é" * 5000, "a\n\n\n  b" * 800, "<|startoftext|>x<|endoftext|>", "Σας ΟΔΟΣ", "İI é don't L'été"]
PIECES = st.lists(st.sampled_from(["a", " ", "\n", "é", "1", "'s", "'", "<|endoftext|>", "字", "  ", "\t", "the ", "Ñ", "÷", "!", "x" * 300]), max_size=400).map("".join)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@settings(max_examples=60, deadline=None)
@given(PIECES)
def test_chunks_agree_with_the_library(byte_library, text):
    own = bpe_chunks.codec(BYTE, RANKS)
    ids = own.encode(text)
    assert ids.tolist() == byte_library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_equal_passages_are_encoded_once(byte_library):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4000))
    own = bpe_chunks.Codec(BYTE, RANKS)
    for head in ("", "another beginning ", "x"):
        assert own.encode(head + passage).tolist() == byte_library.encode(head + passage, add_special_tokens=False).ids
    assert own.reused > own.encoded / 2


def test_reuse_counts_chunks_of_other_documents_only():
    """A passage in two documents, at different places, is encoded for the first of them; a text's own chunks are no reuse,
    and without a memo there is none."""
    words = lambda seed, n: " ".join("".join(random.Random(f"{seed}-{k}").choices("abcdefgh", k=6)) for k in range(n))
    passage, one, two = words(1, 6000), words(2, 900) + " ", words(3, 700) + " "
    chunks = len(bpe_chunks.cuts(np.frombuffer(passage.encode(), np.uint8)))
    own, without = bpe_chunks.Codec(BYTE, RANKS), bpe_chunks.Codec(BYTE, RANKS, memo_bytes=0)
    for codec in (own, without):
        codec.encode(one + passage)
        assert codec.reused == 0
        codec.encode(two + passage)
    assert own.reused >= chunks - 3 and without.reused == 0
    assert own.reused + own.encoded == without.encoded


def test_chunks_that_are_met_again_stay_in_the_memo():
    own = bpe_chunks.Codec(BYTE, RANKS, memo_bytes=40_000)
    texts = [f"text {k} " * 20 for k in range(600)]
    for k, text in enumerate(texts):
        own.encode(text)
        before = own.reused
        if k % 5 == 0:
            own.encode(texts[0])
            assert own.reused == before + 1
    assert own.young_bytes <= 20_000 and len(own.young) + len(own.old) < 300


def test_bpe_query_against_the_library(spark, byte_library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_bpe_chunk_reuse(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = byte_library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoded_documents_decode_to_their_texts(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "long " * 50_000, "x")], "doc_id long, text string, n_tokens string")
    made = bpe_chunks.encode_documents(df, BYTE, RANKS)
    back = sorted((str(r.doc_id), len(r.text)) for r in bpe_chunks.decode_documents(made, BYTE).collect())
    assert back == [("1", 3), ("1", 3), ("2", 0), ("None", 250_000)]
    assert bpe_chunks.encode_documents(df.limit(0), BYTE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=5))
def test_words_agree_with_the_library(word_library, texts):
    check_words(word_library, texts)


def test_odd_words_agree_with_the_library(word_library):
    check_words(word_library, [*ODD, "".join(f"A{chr(c)}b {chr(c)}1 " for c in range(1, 0x600))])


def check_words(library, texts):
    ids, lengths = token_files.encoder(WORD).encode(pa.array(texts), 2)
    for text, end, n in zip(texts, np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
        assert ids[end - n : end].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.minimum(rng.zipf(1.3, n), 49_999), np.zeros(n, np.int64)):
        block = range_coder.encode(ids, 50_000)
        assert range_coder.decode(block).tolist() == ids.tolist()
    assert n < 1000 or len(range_coder.encode(np.zeros(n, np.int64), 50_000)) < n


def test_damaged_blocks_are_refused():
    block = bytearray(range_coder.encode(np.arange(500), 1000))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(block))


def test_damaged_keys_and_lengths_are_refused(spark):
    blocks = token_files.write_blocks(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), WORD)
    assert len(token_files.read_blocks(blocks).collect()) == 2
    for column in ("keys", "lengths"):
        with pytest.raises(Exception, match="damaged keys or lengths"):
            token_files.read_blocks(blocks.withColumn(column, F.reverse(column))).collect()


def test_one_key_with_many_texts_is_cut_between_them(spark):
    df = spark.createDataFrame([(None if k % 3 else 7, f"text {k}") for k in range(600)], "doc_id long, text string")
    blocks = token_files.write_blocks(df, WORD, shard_bytes=400)
    assert max(r.n for r in blocks.groupBy("shard").agg(F.sum(F.size("keys")).alias("n")).collect()) < 200
    rows = sorted(token_files.read_blocks(blocks).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None] * 400 + [7] * 200


def test_token_files_against_the_library(spark, word_library):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    assert len(rows) == len(docs)
    start = 0
    for key, text in docs:
        ids = [*word_library.encode(text, add_special_tokens=False).ids, 2]
        r = rows[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_with_nulls_repeats_and_many_blocks(spark):
    df = spark.createDataFrame([(2, "b b", 0), (2, "b b", 0), (None, "n", 0), (1, None, 0), (3, "w " * 9000, 0)], "doc_id long, text string, start long")
    rows = token_files.read_blocks(token_files.write_blocks(df, WORD, shard_bytes=5000, block_ids=100), with_ids=True).collect()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.key for r in ordered] == [None, 1, 2, 2, 3] and [r.n_tokens for r in ordered] == [2, 1, 3, 3, 9001]
    assert [r.start for r in ordered] == [0, 2, 3, 6, 9] and ordered[1].ids == [2]
    assert token_files.read_blocks(token_files.write_blocks(df.limit(0), WORD)).collect() == []


def test_mixing_beats_static_order_0_at_any_block_size():
    """Ids of real texts: a block, its first tenth, and a few; order 0 is counted on the ids themselves and pays for no table."""
    import pandas as pd
    from tokenizers import Tokenizer

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").tolist()
    library = Tokenizer.from_file(WORD)
    ids = np.concatenate([[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)])
    for n, share in ((len(ids), 0.94), (len(ids) // 3, 0.97)):
        counts = np.bincount(ids[:n])
        part = counts[counts > 0] / n
        order0 = -(part * np.log2(part)).sum() / 8
        block = range_coder.encode(ids[:n], library.get_vocab_size())
        assert len(block) / n < share * order0
        assert (range_coder.decode(block) == ids[:n]).all()

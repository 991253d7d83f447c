from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import FOLDER
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from tarn.llm import piece_offsets, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "\n", "\n\n a \n b", "▁", "▁a", "a▁ b", "日本語 テスト", "😀 😀a\u0000b", "  x  \t\r\n y " * 50, " a", "<s>", "</s> <0x0A> <unk>", "é", "á ﻿", "x" * 20_000]
RULED = ["ﬁ① Ａ́é ㌔  x　y​ ", "ガ゛ ｶﾞ", "  a", "Ǻ ſ", "　　", "​", "㍿ ½ x ", "áb"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]


def spans(library, text: str) -> list[tuple[int, int]]:
    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(library.encode(text, out_type="serialized_proto"))
    return [(p.begin, p.end) for p in found.pieces]


def test_whole_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op12_piece_offsets(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_and_spans_against_the_library(library, texts):
    own = piece_offsets.Pieces(PATH)
    said = [*ODD, *RULED, *texts[:60]]
    for text, (ids, begins, ends) in zip(said, own.encode_batch(said), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert list(zip(begins[:-1].tolist(), ends[:-1].tolist(), strict=True)) == spans(library, text)
        assert begins[-1] == ends[-1] == len(text.encode())
        covered = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends, strict=True)])
        assert (covered == np.arange(len(text.encode()))).all()  # identity map: the spans are the text, in order


def test_decoding_any_ids_against_the_library(library):
    own, draw = piece_offsets.Pieces(PATH), random.Random(5)
    for k in range(3000):
        ids = [draw.randrange(300 if k % 2 else 32_000) for _ in range(draw.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps_against_the_library(rule, squeeze, texts):
    """Longest-prefix normalisation and its record of source characters, with maps that hold thousands of prefixes."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(made.serialized_model_proto())
    spec = model.normalizer_spec
    own = piece_offsets.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in [*ODD, *RULED, *texts[:15]]:
        want, places = made.normalize(text, with_offsets=True)
        got, align = own(text.encode())
        assert got.decode() == want
        starts = [i for i, b in enumerate([*got, 0]) if b & 0xC0 != 0x80]
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        assert [int(np.searchsorted(at, align[i])) for i in starts][: len(places)] == list(places)


def test_nulls_repeats_clashes_and_round_trip(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "é 日本", None, None), (2, "twice", "c", 3), (2, "twice", "c", 3), (3, " long" * 50_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = piece_offsets.encode_documents(docs, PATH)
    back = piece_offsets.decode_documents(found, PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert {tuple(r.ids) for r in found.filter("doc_id = 1").collect()} == {(2,)}
    assert piece_offsets.encode_documents(docs.limit(0), PATH).collect() == []
    assert piece_offsets.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0].text == ""

from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st
from oracle import FOLDER, assert_same
from pyspark.sql import functions as F

from tarn.llm import chat_parts, queries, sql


def test_query_against_sql(spark):
    assert_same(queries.op5_chat_parts(spark, FOLDER), sql.OP5)


@given(st.lists(st.sampled_from(["<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<|end|>", "\n", "a", "<<SYS>>", "é"]), max_size=30).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat_parts.escape(text)
    assert chat_parts.unescape(escaped) == text
    assert not any(c in escaped for c in chat_parts.CONTROL)


def test_the_probe_conversation(spark):
    row = next(r for r in queries.op5_chat_parts(spark, FOLDER).collect() if r.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_parts_become_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), None]), (1, 1, "assistant", None), (None, None, None, [])]
    made = chat_parts.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_parts.PART}>"))
    first = made.filter("conv_id = 1 and turn = 0").first()
    assert first.segment == "<|turn|>user\nsee <|image:0|><|audio:1|><|document:2|><|end|>\n"
    assert [(a.position, a.kind, a.ref, a.n_tokens) for a in first.attachments] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 50), (2, "document", "d.pdf", 1536)]
    back = {r.conv_id: r for r in chat_parts.read_back(made).collect()}
    assert back[1].n_turns == 2 and back[1].n_media_tokens == 1589 and back[1].loss_chars == 0
    assert back[None].n_turns == 1


def test_empty_long_and_tied_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame([(1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "user", None), (2, 0, "assistant", "x" * 300_000)], schema)
    parts = turns.select("conv_id", "turn", "role", chat_parts.text_parts().alias("parts"))
    back = {r.conv_id: r for r in chat_parts.read_back(chat_parts.format_turns(parts)).collect()}
    assert back[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and back[2].loss_chars == 300_000
    assert chat_parts.read_back(chat_parts.format_turns(parts.filter(F.lit(False)))).collect() == []


def test_roles_of_any_text_read_back(spark):
    roles = ["us\ner", "a\\", "\n", "<|end|>\n<|turn|>x", "", "\\\n"]
    turns = spark.createDataFrame([(k, 0, role, "said\n" + role) for k, role in enumerate(roles)], "conv_id long, turn long, role string, text string")
    made = chat_parts.format_turns(turns.select("conv_id", "turn", "role", chat_parts.text_parts().alias("parts")))
    for r in made.collect():
        role, content = chat_parts._SEGMENT.fullmatch(r.segment).groups()
        assert chat_parts.unescape(role) == roles[r.conv_id] and chat_parts.unescape(content) == "said\n" + roles[r.conv_id]
    for r in chat_parts.read_back(made).collect():
        assert r.turns_sha256 == hashlib.sha256(f"{roles[r.conv_id]}\nsaid\n{roles[r.conv_id]}\n".encode()).hexdigest()


def test_tied_turns_are_ordered_by_what_was_said(spark):
    """One text begins another, and escapes would change the order."""
    said = ["a", "a!", "[INST]", "[Z", "<|x", "<a", "\\", "\\a", "", "]", "a\nb"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in said], "conv_id long, turn long, role string, text string")
    row = chat_parts.read_back(chat_parts.format_turns(turns.select("conv_id", "turn", "role", chat_parts.text_parts().alias("parts")))).first()
    assert row.turns_sha256 == hashlib.sha256("".join(f"user\n{t}\n" for t in sorted(said, key=str.encode)).encode()).hexdigest()

"""Statistics of whole documents, computed for slices of a batch at once."""

from __future__ import annotations

import numpy as np

from tarn.llm.textarrays import BLANKS, Text, Words, lines_of, marking, words_of

SYMBOL, STOP = marking([*b"#*$%&|<>"]), marking([*b".!?"])
UPPER, LOWER, DIGIT = marking([*range(65, 91)]), marking([*range(97, 123)]), marking([*range(48, 58)])
LEAD = marking([b for b in range(256) if b & 0xC0 != 0x80])  # the first byte of each character
IN_WORDS = marking([b for b in range(256) if b & 0xC0 != 0x80 and b not in BLANKS])
WIDE = marking([b for b in range(0xC0, 256)])


def repeated_words(words: Words) -> np.ndarray:
    """Per row, the words that lie in a three-word window which occurs at least twice in that row."""
    codes, first, rows = words.codes.astype(np.uint64), words.first, len(words.first) - 1
    row = words.rows()
    if len(codes) < 3:
        return np.zeros(rows, np.int64)
    size = np.uint64(max(1, len(words.vocab)))
    if len(words.vocab) < 1 << 21:
        window = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:  # a third factor would pass 64 bits
        pair = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)[1].astype(np.uint64)
        window = pair * size + codes[2:]
    inside = row[:-2] == row[2:]
    at, window = np.flatnonzero(inside), window[inside]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    at, key = at[often], inverse[often].astype(np.int64) + row[at[often]].astype(np.int64) * len(counts)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    covered = np.zeros(len(codes), bool)
    for step in range(3):
        covered[at + step] = True
    return np.bincount(row[covered], minlength=rows)


def repeated_lines(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the lines that have a word, and those of them that equal an earlier line of the row."""
    rows = len(text.offsets) - 1
    row, code, solid = lines_of(text)
    row, code = row[solid > 0].astype(np.int64), code[solid > 0]
    if not len(row):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    width = int(code.max()) + 1
    lines = np.bincount(row, minlength=rows)
    return lines, lines - np.bincount(np.unique(row * width + code) // width, minlength=rows)


def measures(text: Text) -> dict[str, np.ndarray]:
    """The counts that quality rules and the quality classifier are built on; one array entry per row."""
    words = words_of(text)
    count = lambda table: text.per_row(text.marked(table))
    lines, dup = repeated_lines(text)
    length = np.fromiter(map(len, words.vocab.to_pylist()), np.int64, len(words.vocab))
    row = words.rows()
    rows = len(text.offsets) - 1
    n_words = np.diff(words.first)
    seen = np.unique(row.astype(np.int64) * max(1, len(length)) + words.codes) // max(1, len(length)) if len(row) else row
    return {
        "n_words": n_words,
        "word_chars": count(IN_WORDS),
        "n_symbols": count(SYMBOL),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_code_points": count(LEAD),
        "n_upper": count(UPPER),
        "n_lower": count(LOWER),
        "n_digits": count(DIGIT),
        "n_stops": count(STOP),
        "n_wide": count(WIDE),
        "n_distinct": np.bincount(seen, minlength=rows),
        "n_long_words": np.bincount(row[length[words.codes] > 20], minlength=rows) if len(row) else np.zeros(rows, np.int64),
    }

r"""Secret scanning: fixed patterns, and a character convolutional network over every candidate.

The patterns always count.  Candidates are all runs of 12 or more characters out of ``A-Za-z0-9+/_-`` (with closing ``=``),
ordinary long words included, and every value that a pattern found in a shorter run.  The network scores each of them, with
the characters around it: a one-hot layer over character classes, two convolution widths, maximum and mean over positions,
and a logistic unit, all in numpy.  A longer candidate is seen through several windows, and the best one counts.  An accepted
candidate that is not part of a pattern's span is a span of its own (so a token around a pattern's span widens it), and
each span carries its score.

The network is trained on labelled findings (context, candidate, label, group): candidates of a bounded sample of documents,
labelled by the patterns, and made ones for forms that no pattern knows.  Groups (documents) are kept together: a fifth of
them is left out for calibration and the threshold, the highest that keeps a given recall there.  Documents of the held-out
fold are in neither.

Defined results: a null text counts as empty and has no spans; spans are code points, end exclusive; repeated rows are
scanned alike; an empty table gives no rows, and only made findings to train on; of long texts and candidates everything is
seen; only the ``keep`` columns pass through.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.labelled import held_out
from tarn.llm.storage import stored
from tarn.llm.textarrays import slices

# The base patterns, and their order where spans begin at the same place.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
CONTEXT, ROOM = 24, 64
WIDTH = ROOM + 2 * CONTEXT
Span = tuple[int, int, str]


class Match(NamedTuple):
    """A pattern's span, its kind, and the part of it that is the secret."""

    start: int
    end: int
    kind: str
    value_start: int
    value_end: int


class Finding(NamedTuple):
    """A labelled candidate in its context; findings of one group (a document) stay on one side of a split."""

    text: str
    start: int
    end: int
    label: int
    group: int


def base_matches(text: str) -> list[Match]:
    """The patterns' matches, leftmost and non-overlapping for each kind, in order of start and kind."""
    found: list[Match] = []
    if ":" in text or "=" in text:
        found += [Match(*m.span(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Match(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Match(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def base_spans(text: str) -> list[Span]:
    return [m[:3] for m in base_matches(text)]


def _touching(runs: list[tuple[int, int]], start: int, end: int) -> range:
    """Which of the runs, sorted and apart from one another, share a character with the span."""
    return range(bisect_right(runs, start, key=lambda r: r[1]), bisect_left(runs, end, key=lambda r: r[0]))


def candidates(text: str, base: list[Match]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Every candidate, and for each match which of them touch its value: long runs, or the value itself where there is none."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    out, of_base = list(runs), []
    for m in base:
        at = list(_touching(runs, m.value_start, m.value_end))
        if not at:
            at = [len(out)]
            out.append((m.value_start, m.value_end))
        of_base.append(at)
    return out, of_base


_CLASSES = np.full(256, 1, np.uint8)
for _i, _group in enumerate((string.digits, "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/=", "-_", "\"'`", ":=", ".,;!?", " \t", "\n\r", "(){}[]<>", "@#$%&*|")):
    for _c in _group:
        _CLASSES[ord(_c)] = _i + 2
N_CLASSES = 16
INSIDE, CHANGE = 16, 32  # bits of a code: the character belongs to the candidate; it does, and its class is a new one there
N_CODES = 64


def windows(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x WIDTH) of the windows over all candidates (text, start, end), and the candidate of each window.

    A window holds up to ROOM characters of the candidate and CONTEXT characters on either side; a longer candidate has
    windows one after another, the last of them at its end.
    """
    rows, inside, owner = [], [], []
    for k, (text, start, end) in enumerate(found):
        for s in [*range(start, end - ROOM, ROOM), max(start, end - ROOM)]:
            stop = min(end, s + ROOM)
            row = text[max(0, s - CONTEXT) : s].rjust(CONTEXT) + text[s : stop + CONTEXT]
            rows.append(row.ljust(WIDTH))
            inside.append((CONTEXT - min(CONTEXT, s - start), CONTEXT + stop - s + min(CONTEXT, end - stop)))
            owner.append(k)
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    codes = np.where(points < 256, _CLASSES[np.minimum(points, 255)], 0).astype(np.uint8)
    edge, at = np.array(inside, np.int64).reshape(-1, 2), np.arange(WIDTH)
    own = (at >= edge[:, :1]) & (at < edge[:, 1:])
    new = np.zeros_like(own)
    new[:, 1:] = (codes[:, 1:] != codes[:, :-1]) & own[:, 1:]
    return codes + np.uint8(INSIDE) * own + np.uint8(CHANGE) * new, np.array(owner, np.int64)


@dataclass
class Network:
    """kernels: per width, (width, inputs, filters) and biases; dense: weights over all filters; then calibration."""

    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def inputs(codes: np.ndarray) -> np.ndarray:
        return _ONE_HOT[codes]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        pooled, trace = [], []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            width = len(kernel)
            patches = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - width + 1, -1)
            raw = patches @ kernel.reshape(-1, kernel.shape[2]) + bias
            at = raw.argmax(axis=1)
            top = np.take_along_axis(raw, at[:, None, :], axis=1)[:, 0]
            mean = np.maximum(raw, 0).mean(axis=1)
            pooled += [np.maximum(top, 0), mean]
            trace.append((patches, raw, at, top))
        joined = np.concatenate(pooled, axis=1)
        return joined @ self.dense + self.bias, [joined, trace]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated scores of windows.  A convolution over one-hot codes is a sum of table rows, one for each place in it."""
        tables = [np.einsum("ci,wif->wcf", _ONE_HOT, k).astype(np.float32) for k in self.kernels]
        z = np.zeros(len(codes))
        for low in range(0, len(codes), 256):
            part, pooled = codes[low : low + 256], []
            for table, bias in zip(tables, self.biases, strict=True):
                length = WIDTH - len(table) + 1
                raw = table[0][part[:, :length]] + bias
                for j in range(1, len(table)):
                    raw += table[j][part[:, j : j + length]]
                np.maximum(raw, 0, out=raw)
                pooled += [raw.max(axis=1), raw.mean(axis=1)]
            z[low : low + 256] = np.concatenate(pooled, axis=1) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def score(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Scores of candidates (text, start, end): that of the best window."""
        out = np.zeros(len(found))
        codes, owner = windows(found)
        np.maximum.at(out, owner, self.scores(codes))
        return out


_ONE_HOT = np.zeros((N_CODES, N_CLASSES + 2), np.float32)
_ONE_HOT[np.arange(N_CODES), np.arange(N_CODES) % N_CLASSES] = 1
_ONE_HOT[np.arange(N_CODES) & INSIDE > 0, N_CLASSES] = 1
_ONE_HOT[np.arange(N_CODES) & CHANGE > 0, N_CLASSES + 1] = 1


def train(findings: list[Finding], filters: int = 12, widths: tuple[int, ...] = (3, 6), epochs: int = 12, rate: float = 0.01, recall: float = 0.98, seed: int = 3) -> Network:
    """Fits the network on four fifths of the groups; the rest is for calibration and the threshold."""
    rng = np.random.default_rng(seed)
    aside = np.array([zlib.crc32(b"%d" % f.group) % 5 == 0 for f in findings], bool)
    labels = np.array([f.label for f in findings], np.float32)
    codes, owner = windows([f[:3] for f in findings])
    y, out = labels[owner], aside[owner]
    x, target = Network.inputs(codes[~out]), y[~out]
    kernels = [rng.normal(0, 0.2, (w, N_CLASSES + 2, filters)).astype(np.float32) for w in widths]
    net = Network(kernels, [np.zeros(filters, np.float32) for _ in widths], np.zeros(2 * filters * len(widths), np.float32) + rng.normal(0, 0.1, 2 * filters * len(widths)).astype(np.float32), 0.0)
    weights = [*net.kernels, *net.biases, net.dense]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(order), 64):
            part = order[low : low + 64]
            z, (joined, trace) = net.forward(x[part])
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - target[part]) / len(part)
            grads: list[np.ndarray] = []
            bias_grads: list[np.ndarray] = []
            for k, (patches, raw, at, top) in enumerate(trace):
                at_top = error[:, None] * net.dense[2 * k * filters : (2 * k + 1) * filters] * (top > 0)
                spread = error[:, None, None] * net.dense[(2 * k + 1) * filters : (2 * k + 2) * filters] * (raw > 0) / raw.shape[1]
                np.put_along_axis(spread, at[:, None, :], np.take_along_axis(spread, at[:, None, :], axis=1) + at_top[:, None, :], axis=1)
                grads.append(np.tensordot(patches, spread, axes=([0, 1], [0, 1])).reshape(net.kernels[k].shape))
                bias_grads.append(spread.sum(axis=(0, 1)))
            step += 1
            net.bias -= rate * float(error.sum())
            for i, g in enumerate([*grads, *bias_grads, joined.T @ error]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    kept = [f for f, a in zip(findings, aside, strict=True) if a]
    if kept and 0 < labels[aside].mean() < 1:
        z = net.forward(Network.inputs(codes[out]))[0]
        w, design = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2), design.T @ (p - y[out]) + (w - [1.0, 0.0]))
        net.slope, net.shift = float(w[0]), float(w[1])
        positive = np.sort(net.score([f[:3] for f in kept])[labels[aside] == 1])
        net.threshold = float(positive[int((1 - recall) * len(positive))])
    return net


def labelled_findings(docs: DataFrame, documents: int = 20_000, most: int = 4_000, key: str = "doc_id", text: str = "text") -> list[Finding]:
    """Candidates of documents, labelled by whether a pattern's value touches them.

    About ``documents`` documents outside the held-out fold are read, those least by a hash of key and text, and at most
    ``most`` candidates come to the driver of each of three sorts: findings of the patterns, other candidates with digits,
    capitals or signs, and plain words.  Of a candidate over 256 characters its first 256 are learnt from.
    """
    n = docs.count()
    share = int(min(1.0, documents / max(1, n)) * (1 << 30))
    mixed = F.xxhash64(key, text)
    sample = docs.filter(~held_out(key) & (F.pmod(mixed, F.lit(1 << 30)) < share)).select(mixed.alias("_group"), F.col(text).alias("_text"))
    schema = "group long, sort int, start int, end int, text string"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = []
            for group, whole in zip(part["_group"].to_pylist(), part["_text"].to_pylist(), strict=True):
                base = base_matches(whole or "")
                found, of_base = candidates(whole or "", base)
                secret = {k for at in of_base for k in at}
                for k, (a, b) in enumerate(found):
                    low, b = max(0, a - CONTEXT), min(b, a + 256)
                    sort = 0 if k in secret else 2 if whole[a:b].isalpha() and whole[a + 1 : b].islower() else 1
                    rows.append((group, sort, a - low, b - low, whole[low : b + CONTEXT]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["group", "sort", "start", "end", "text"])

    found = stored(sample.mapInArrow(run, schema), "secret-findings")
    chosen = [found.filter(F.col("sort") == k).orderBy(F.xxhash64("group", "text", "start"), "text", "start").limit(most) for k in range(3)]
    return [Finding(r.text, r.start, r.end, int(r.sort == 0), r.group) for df in chosen for r in df.collect()]


def made_findings(n: int = 3000, seed: int = 17) -> list[Finding]:
    """Labelled findings of forms that no pattern knows: secrets are random strings of several alphabets in the contexts where
    they are found; the rest are identifiers, paths, numbers, dates and joined or long words that look alike."""
    r = random.Random(seed)
    lower, letters = string.ascii_lowercase, string.ascii_letters
    syllables = ["".join(r.choice(lower) for _ in range(r.randint(2, 4))) for _ in range(400)]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    alphabets = (letters + string.digits, letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits, letters + string.digits + "_-")
    leads = ("key = \"", "Authorization: Bearer ", "export AUTH=", "pwd is ", "credential ", "private: ", "", " ", "login ")

    def secret() -> str:
        made = "".join(r.choice(a) for a in [r.choice(alphabets)] for _ in range(r.randint(16, 90)))
        return r.choice(("", "", "ghp_", "sk-", "xox-")) + made

    def harmless() -> str:
        kind = r.randrange(8)
        if kind == 0:
            return "_".join(word() for _ in range(r.randint(2, 5))) + str(r.randint(0, 99))
        if kind == 1:
            return "/".join(word() for _ in range(r.randint(3, 6))) + "/" + str(r.randint(1, 2030))
        if kind == 2:
            return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-" + "-".join(word() for _ in range(2))
        if kind == 3:
            return "".join(word().capitalize() for _ in range(r.randint(3, 5))) + str(r.randint(0, 9))
        if kind == 4:
            return str(r.randint(10**12, 10**16)) + r.choice(["", "ms", "kg", "px"]) + word()
        if kind == 5:
            return str(r.randint(10**12, 10**16))
        if kind == 6:
            long = "".join(r.choices(syllables, k=r.randint(4, 8)))
            return r.choice((long, long.upper(), long.capitalize()))
        return "-".join(word() for _ in range(r.randint(3, 6))) + "-v" + str(r.randint(1, 20))

    out = []
    while len(out) < n:
        label = r.random() < 0.5
        own = secret() if label else harmless()
        if not CANDIDATE.fullmatch(own) or label and own.isdigit():
            continue
        left = " ".join(word() for _ in range(r.randint(0, 5))) + r.choice(leads if label or r.random() < 0.2 else ("", " ", "see ", "file "))
        out.append(Finding(left + own + r.choice(('"', " ", ".", "\n", "")) + " ".join(word() for _ in range(r.randint(0, 5))), len(left), len(left) + len(own), int(label), len(out)))
    return out


class Scan(NamedTuple):
    """base: the patterns' spans.  spans: all spans.  scores: of each of them.  candidates: how many were scored."""

    base: list[Span]
    spans: list[Span]
    scores: list[float]
    candidates: int


def scans(texts: list[str | None], net: Network) -> list[Scan]:
    """Scans texts; the candidates of all of them are scored together."""
    read, asked = [], []
    for text in texts:
        base = base_matches(text or "")
        found, of_base = candidates(text or "", base)
        read.append((base, found, of_base))
        asked += [(text, a, b) for a, b in found]
    scores, low, out = net.score(asked).tolist(), 0, []
    for base, found, of_base in read:
        own = scores[low : low + len(found)]
        low += len(found)
        spans = [(*m[:3], max(own[k] for k in at)) for m, at in zip(base, of_base, strict=True)]
        covered = {k for m, at in zip(base, of_base, strict=True) for k in at if m.start <= found[k][0] and found[k][1] <= m.end}
        spans += [(*found[k], "cnn", p) for k, p in enumerate(own) if p >= net.threshold and k not in covered]
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        out.append(Scan([m[:3] for m in base], [s[:3] for s in spans], [s[3] for s in spans], len(found)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, n_assign, n_access, n_hex, base_sha256, spans, n_candidates (how many the network scored), n_added (spans
    of its own), and ``found``: the spans with their scores as an array of structs."""
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_added long, found array<struct<kind:string,start:long,end:long,score:double>>"
    schema = T.StructType([docs.schema[k] for k in keep] + list(T._parse_datatype_string(fields)))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = scans(part["_text"].to_pylist(), net)
            counts = [pa.array([sum(s[2] == kind for s in r.base) for r in rows], pa.int64()) for kind in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(r.base).encode()).hexdigest() for r in rows])
            scored = [pa.array([r.candidates for r in rows], pa.int64()), pa.array([len(r.spans) - len(r.base) for r in rows], pa.int64())]
            found = pa.array([[{"kind": k, "start": a, "end": b, "score": p} for (a, b, k), p in zip(r.spans, r.scores, strict=True)] for r in rows], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *counts, digests, pa.array([joined(r.spans) for r in rows]), *scored, found], schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, net: Network, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark`` (overlapping spans by one); ``length``, where it is
    one of the columns, becomes the new number of code points."""
    columns, schema = docs.columns, docs.schema
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            made, texts = [], part[text].to_pylist()
            for whole, read in zip(texts, scans(texts, net), strict=True):
                out, done = [], 0
                for start, end, _ in read.spans:
                    if start >= done:
                        out += [whole[done:start], mark]
                    done = max(done, end)
                made.append("".join([*out, whole[done:]]) if out else whole)
            arrays = list(part.columns)
            arrays[at] = pa.array(made, part.schema.field(text).type)
            if length in columns:
                k = columns.index(length)
                arrays[k] = pa.array([old if new == was else len(new) for old, new, was in zip(part[length].to_pylist(), made, part[text].to_pylist(), strict=True)], part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, schema)

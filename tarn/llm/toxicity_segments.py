"""Toxicity by maximum-scoring segments of token log-odds.

Fitting: tokens of a bounded sample of labelled documents are counted by label.  Every token that is in enough of its
documents has a log-odds between toxic and clean ones, under a Dirichlet prior in proportion to how common the token is, so
rare tokens stay near zero and tokens never seen in clean text stay finite.  Rarer tokens take that of their first five
letters where these are common enough, else zero.  All scores are shifted so that clean text drifts down, as segment
statistics require.

Scoring: a linear scan finds all maximal scoring segments of a text (those that no longer or shorter neighbour improves).
By extreme-value theory the number of segments of clean text that reach score S in n tokens is about K n exp(-lambda S);
lambda solves sum p_i exp(lambda s_i) = 1 over the scores of clean tokens, K is estimated from clean sample documents.  Segments whose
expected number is below a level are the significant passages.  A document's evidence, minus the logarithm of the
best segment's p-value and of the pooled ones, is turned into a probability by a logistic curve fitted on the sample.

Tokens: runs outside ASCII white space, lower-cased, without non-alphanumeric characters at their ends.

Defined results: null texts count as empty, have no segments and get the score of no evidence; repeated rows score alike;
an empty table gives no rows; without toxic sample rows every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.jaccard_join import Params, minhashes, shingles
from tarn.llm.labelled import held_out, training_rows
from tarn.llm.storage import stored
from tarn.llm.textarrays import encoded, slices, text_of, word_keys, words_of


STEM = 5


@dataclass
class Model:
    weights: dict[str, float]
    shift: float  # added to every token's score
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    curve: tuple[float, ...] = (0.0, 0.0, -3.0)
    level: float = 0.01

    def log_expected(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Logarithm of how many segments of clean text of so many tokens reach the score."""
        return np.log(self.scale * np.maximum(tokens, 1)) - self.rate * np.asarray(score, np.float64)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (begin, end, score) in order.

    Kept candidates are a stack; each remembers the cumulative score before and after it.  A new positive score joins the
    stack; while some earlier candidate starts lower and ends lower than the new one, all from that candidate on are merged
    with it.  Every candidate is pushed once and merged at most once.  Runs without positive scores are skipped at once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []
    jump: list[int] = []  # for each candidate, the nearest earlier one that starts lower, or -1
    for at in np.flatnonzero(scores > 0).tolist():
        begin, end, left, right = at, at + 1, total[at], total[at + 1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = jump[k]
            if k < 0 or stack[k][3] >= right:
                break
            begin, left = stack[k][0], stack[k][2]
            del stack[k:], jump[k:]
        stack.append((begin, end, left, right))
        jump.append(k)
    return [(b, e, float(r - l)) for b, e, l, r in stack]


def stem(token: str) -> str:
    """What stands in for a token without a weight of its own: its first letters, marked; short tokens have no stem."""
    return token[:STEM] + "*" if len(token) > STEM else ""


def _weights(model: Model, vocab: pa.Array) -> np.ndarray:
    keys, known, shift = word_keys(vocab), model.weights, model.shift
    found = ((known[k] if k in known else known.get(stem(k), 0.0)) + shift if k else 0.0 for k in keys)
    return np.fromiter(found, np.float64, len(keys))


def passages(column: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For every text its number of words and its maximal segments in words."""
    words = words_of(text_of(column))
    weight = _weights(model, words.vocab)[words.codes] if len(words.vocab) else np.zeros(0)
    hot = np.concatenate([[0], np.cumsum(weight > 0)])
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield b - a, maximal_segments(weight[a:b]) if hot[b] > hot[a] else []


def evidence(column: pa.Array, model: Model) -> np.ndarray:
    """rows x 2: minus log p of the best segment, and the sum of what significant segments have beyond the level."""
    out = np.zeros((len(column), 2))
    for row, (n, found) in enumerate(passages(column, model)):
        if found:
            log_e = model.log_expected(np.array([s for _, _, s in found]), np.full(len(found), n))
            best = float(log_e.min())
            # p = 1 - exp(-E), which is E where E is small
            out[row, 0] = -best if best < -20 else -np.log(-np.expm1(-np.exp(best)))
            over = np.log(model.level) - log_e
            out[row, 1] = over[over > 0].sum()
    return out


def _design(found: np.ndarray) -> np.ndarray:
    return np.stack([found[:, 0], np.log1p(found[:, 1]), np.ones(len(found))], axis=1)


def probability(found: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(found) @ np.array(model.curve), -30, 30)))


def one_of_each(sample: DataFrame) -> DataFrame:
    """Drops copies and near copies from the sample, which would make the words of one text look typical of its label.

    Two texts that agree in one of two MinHash values over five-word shingles count as copies; of a group the row with the
    least (label, key) stays.
    """
    params = Params(bands=2, rows=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            hashes, first = shingles(text_of(part["_text"]), params.words)
            keys = minhashes(hashes, first, params).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], [*part.schema.names, "_m0", "_m1"])

    rows = sample.mapInArrow(run, T.StructType([*sample.schema.fields, T.StructField("_m0", T.LongType()), T.StructField("_m1", T.LongType())]))
    for key in ("_m0", "_m1"):
        rows = rows.groupBy(key).agg(F.min(F.struct("_label", "_key", *(c for c in rows.columns if c not in (key, "_label", "_key")))).alias("r")).select(key, "r.*")
    return rows.select("_key", "_text", "_label")


def token_counts(sample: DataFrame) -> DataFrame:
    """token, and in how many toxic and in how many clean documents it is; summed per slice before the shuffle."""
    names = ("toxic", "clean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            words = words_of(text_of(part["_text"]))
            if not len(words.codes):
                continue
            row = words.rows()
            toxic = part["_label"].to_numpy(zero_copy_only=False).astype(bool)
            keys = word_keys(words.vocab)
            for level in (keys, [stem(k) for k in keys]):
                codes, vocab = encoded(pa.array(level))
                codes, size = codes[words.codes], len(vocab)
                pairs = np.unique(row.astype(np.int64) * size + codes)
                by = [np.bincount((pairs % size)[toxic[pairs // size] == side], minlength=size) for side in (True, False)]
                yield pa.RecordBatch.from_arrays([vocab, *(pa.array(v, pa.int64()) for v in by)], ["token", *names])

    counted = sample.select("_text", "_label").mapInArrow(run, "token string, toxic long, clean long")
    return counted.filter("token <> ''").groupBy("token").agg(*(F.sum(c).alias(c) for c in names))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, prior: float = 5_000.0, least_docs: int = 5, drift: float = 1.0, key: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most ``rows`` labelled documents outside the held-out fold.

    Counts are made in Spark; the log-odds of tokens in ``least_docs`` sample documents or more come to the driver, as many as
    the sample has, and a few numbers for each sample document.  ``prior`` is the prior's mass for a label, in uses of tokens
    counted once a document; ``drift`` is what a clean token loses in the mean.
    """
    sample = stored(training_rows(docs, labels, label, rows, key, text), "toxicity-sample")
    counts = token_counts(one_of_each(sample))
    counts = stored(counts, "toxicity-counts")
    total = counts.filter(~F.col("token").endswith("*")).agg(*(F.sum(c).alias(c) for c in ("toxic", "clean"))).first()
    toxic, clean = (float(v or 0) for v in total)
    share = sample.agg(F.avg("_label")).first()[0]
    share = 0.5 if share is None else float(share)
    if not toxic or not clean:
        return Model({}, -1.0, curve=(0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
    mass = F.lit(prior) * (F.col("toxic") + F.col("clean")) / (toxic + clean)
    side = lambda n, all_n: F.log((F.col(n) + mass) / (F.lit(all_n + prior) - F.col(n) - mass))
    chosen = counts.filter(F.col("toxic") + F.col("clean") >= least_docs).select("token", (side("toxic", toxic) - side("clean", clean)).alias("w")).toPandas()
    model = Model(dict(zip(chosen["token"], chosen["w"], strict=True)), 0.0)
    scores = clean_scores(sample, model).toPandas().sort_values("score")
    p, s = scores["n"].to_numpy(np.float64) / scores["n"].sum(), scores["score"].to_numpy()
    model.shift = -drift - float((p * s).sum())
    model.rate = _decay(p, s + model.shift)
    return _calibrated(model, sample)


def clean_scores(sample: DataFrame, model: Model) -> DataFrame:
    """(score, n): how many tokens of the clean sample documents have each score, to two decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            words = words_of(text_of(part["_text"]))
            if len(words.codes):
                score, n = np.unique(np.round(_weights(model, words.vocab), 2)[words.codes], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n, pa.int64())], ["score", "n"])

    return sample.filter("_label = 0").select("_text").mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))


def _decay(p: np.ndarray, s: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, by bisection."""
    low, high = 1e-6, 20.0
    with np.errstate(over="ignore"):
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if (p * np.exp(middle * s)).sum() > 1 else (middle, high)
    return low


def _calibrated(model: Model, sample: DataFrame) -> Model:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = [(n, max((s for _, _, s in found), default=0.0)) for n, found in passages(part["_text"], model)]
            yield pa.RecordBatch.from_arrays([part["_label"].cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["label", "n", "best"])

    tops = sample.select("_text", "_label").mapInArrow(best, "label long, n long, best double").toPandas()
    own = tops[tops["label"] == 0]
    # K: clean documents reach a score as often as the law says, in the mean over their best segments
    reached = own[own["best"] > 0]
    if len(reached):
        level = float(np.median(reached["best"]))
        seen = (own["best"] >= level).mean()
        exposure = np.maximum(1, own["n"]).mean() * np.exp(-model.rate * level)
        model.scale = float(np.clip(-np.log1p(-min(seen, 0.99)) / max(exposure, 1e-12), 1e-6, 10.0))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            x = evidence(part["_text"], model)
            yield pa.RecordBatch.from_arrays([part["_label"].cast(pa.int64()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["label", "a", "b"])

    rows = sample.select("_text", "_label").mapInArrow(found, "label long, a double, b double").toPandas().sort_values(["label", "a", "b"])
    design, y = _design(rows[["a", "b"]].to_numpy()), rows["label"].to_numpy(np.float64)
    w, ridge = np.zeros(3), np.array([1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(w.tolist())
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted, n_passages (significant segments) and passages (first and last word, score, expected)."""
    kind = "array<struct<first_word:long,end_word:long,score:double,expected:double>>"
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("passages", T._parse_datatype_string(kind))])
    arrow = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            kept = []
            for n, found in passages(part["_text"], model):
                spans = [(b, e, s, float(np.exp(model.log_expected(s, n)))) for b, e, s in found]
                kept.append([dict(zip(("first_word", "end_word", "score", "expected"), x, strict=True)) for x in spans if x[3] < model.level])
            scores = probability(evidence(part["_text"], model), model)
            yield pa.RecordBatch.from_arrays([part[key], pa.array(scores), pa.array(kept, arrow)], [key, "score", "passages"])

    scored = docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "passages")

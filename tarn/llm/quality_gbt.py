"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Fitting: features are cut into at most 64 quantile bins, trees grow level by level from per-bin sums of gradients and
hessians of the logistic loss, and are kept as flat arrays (feature, bin, leaf value) of complete binary trees, so scoring
a batch is one vectorised step per level for all rows and trees.  The margin is calibrated by a logistic curve on rows
left out of the boosting.

The fit uses a bounded sample of labelled rows (``rows``, documented below); scoring covers every row and every text whole.

Defined results: a null text counts as empty and is scored like any other; repeated rows score alike; an empty table gives
no rows; if the sample has no rows or a single class, every document gets the share of label 1 (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.labelled import held_out, training_rows
from tarn.llm.text_stats import measures
from tarn.llm.textarrays import slices, text_of

FEATURES = (
    "words", "code_points", "word_length", "symbols", "line_copies", "repeats", "upper", "upper_to_lower", "digits", "stops",
    "wide", "distinct", "long_words", "words_per_line", "lines",
)


def features(column: pa.Array) -> np.ndarray:
    """rows x FEATURES; ratios have at least one in the denominator, so empty texts have finite features."""
    m = {k: v.astype(np.float64) for k, v in measures(text_of(column)).items()}
    words, points, lines = (np.maximum(1, m[k]) for k in ("n_words", "n_code_points", "n_lines"))
    columns = (
        np.log1p(m["n_words"]), np.log1p(m["n_code_points"]), m["word_chars"] / words, m["n_symbols"] / words,
        m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / points, m["n_upper"] / np.maximum(1, m["n_lower"]),
        m["n_digits"] / points, m["n_stops"] / words, m["n_wide"] / points, m["n_distinct"] / words, m["n_long_words"] / words,
        m["n_words"] / lines, np.log1p(m["n_lines"]),
    )
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """cuts: per feature, the ascending bin borders.  feature, border: trees x inner nodes.  leaf: trees x leaves."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    border: np.ndarray
    leaf: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not self.leaf.size:
            return total
        bins, trees = self.binned(x), np.arange(len(self.leaf))[None, :]
        for low in range(0, len(x), 2048):
            part = bins[low : low + 2048]
            row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.leaf)), np.int64)
            while (node[0, 0] if len(part) else 1 << 30) < self.feature.shape[1]:
                node = 2 * node + 1 + (part[row, self.feature[trees, node]] > self.border[trees, node])
            total[low : low + 2048] += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8, seed: int = 5) -> Forest:
    """Boosts on four fifths of the rows and calibrates on the rest."""
    share = float(y.mean()) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for f in range(x.shape[1])]
    inner, leaves = (1 << depth) - 1, 1 << depth
    odds = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    forest = Forest(cuts, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), odds)
    if len(y) < 20 or share in (0.0, 1.0):
        return forest
    part = np.random.default_rng(seed).random(len(y)) < 0.8
    all_bins = forest.binned(x)
    grown, target = all_bins[part], y[part].astype(np.float64)
    n_features, width = x.shape[1], bins
    flat = grown.astype(np.int64) + np.arange(n_features) * width
    margin = np.full(len(grown), odds)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = p - target, p * (1 - p)
        feature, border, node = np.zeros(inner, np.int64), np.full(inner, width, np.int64), np.zeros(len(grown), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (n_features * width) + flat).reshape(-1)
            shape = (nodes, n_features, width)
            sums = [np.bincount(slot, np.repeat(v, n_features), nodes * n_features * width).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(len(g)))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = np.where(split, best // width, 0)
            border[first : first + nodes] = np.where(split, best % width, width)
            node = 2 * node + 1 + (grown[np.arange(len(grown)), feature[node]] > border[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[at]
        made.append((feature, border, leaf))
    forest.feature, forest.border, forest.leaf = (np.stack([m[k] for m in made]) for k in range(3))
    kept = ~part
    if len(set(y[kept].tolist())) == 2:
        forest.slope, forest.shift = _calibrated(forest.margin(x[kept]), y[kept])
    return forest


def _calibrated(margin: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, held near (1, 0) by a ridge so that separable rows stay finite."""
    start = np.array([1.0, 0.0])
    w, design = start.copy(), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = _sigmoid(design @ w)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (p - y) + ridge * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def featured(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_features_of"):
            x = features(part["_features_of"])
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], [*keep, "features"])

    return docs.select(*keep, F.col(text).alias("_features_of")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, key: str = "doc_id", text: str = "text") -> Forest:
    """Fits on at most ``rows`` labelled documents outside the held-out fold; ``rows`` x 15 numbers come to the driver."""
    sample = featured(training_rows(docs, labels, label, rows, key, text), ("_key", "_label"), "_text").toPandas().sort_values("_key")
    x = np.stack(sample["features"].to_numpy()) if len(sample) else np.zeros((0, len(FEATURES)))
    return fit(x, sample["_label"].to_numpy(np.int64))


def score(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, held_out, score and predicted for every document."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part[key], pa.array(forest.score(features(part["_text"])))], [key, "score"])

    scored = docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

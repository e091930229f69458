"""Operator 4: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text.  Trees are grown on quantile-binned
features with gradient histograms, all to the same depth, and kept as flat arrays:
node ``i`` of a level has children ``2i`` and ``2i + 1`` on the next, so a batch of
documents walks all trees at once with array look-ups.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, sliced, unused

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = np.zeros((256, 6 + len(_PUNCT)), np.float64)
_CLASSES[65:91, 0] = 1  # upper
_CLASSES[97:123, 1] = 1  # lower
_CLASSES[48:58, 2] = 1  # digits
_CLASSES[[9, 11, 12, 13, 32], 3] = 1  # white space
_CLASSES[10, 4] = 1  # line ends
_CLASSES[128:, 5] = 1  # beyond ASCII
for _k, _c in enumerate(_PUNCT):
    _CLASSES[_c, 6 + _k] = 1
N_FEATURES = _CLASSES.shape[1] + 14


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; a null text counts as empty (all zero)."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / n
    k = _CLASSES.shape[1]
    out[:k] = counts @ _CLASSES / n
    words, lines = text.split(), text.split("\n")
    m = len(words)
    out[k] = np.log1p(n)
    out[k + 1] = -(share * np.log2(share)).sum()
    out[k + 2] = np.log1p(len(lines))
    out[k + 3] = 1 - len(set(lines)) / len(lines)
    out[k + 4] = len(text) / len(lines)
    if m:
        pairs = list(zip(words, words[1:]))
        found = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        out[k + 5] = np.log1p(m)
        out[k + 6] = len(found) / m
        out[k + 7] = max(found.values()) / m
        out[k + 8] = lengths.mean()
        out[k + 9] = lengths.std()
        out[k + 10] = sum(map(eq, words, words[1:])) / m
        out[k + 11] = len(set(pairs)) / max(1, len(pairs))
        out[k + 12] = sum(map(str.isalpha, words)) / m
        out[k + 13] = (lengths == 1).mean()
    return out


class BoostedTrees:
    """Binary classifier; arrays: feature and threshold by (tree, inner node), value by (tree, leaf)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, weight: float = 1.0, least: float = 2.0) -> BoostedTrees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, d), np.int64)
        p0 = (y.sum() + 1) / (n + 2)
        base = float(np.log(p0 / (1 - p0)))
        raw = np.full(n, base)
        feature, threshold, value = np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), np.inf), np.zeros((trees, 1 << depth))
        if not n:
            return cls(base, feature, threshold, value)
        place = binned + np.arange(d) * bins
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 1 << level
                flat = (node[:, None] * (d * bins) + place).ravel()
                hg = np.bincount(flat, np.repeat(g, d), width * d * bins).reshape(width, d, bins).cumsum(2)
                hh = np.bincount(flat, np.repeat(h, d), width * d * bins).reshape(width, d, bins).cumsum(2)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + weight) + (tg - hg) ** 2 / (th - hh + weight) - tg**2 / (th + weight)
                gain[(hh < least) | (th - hh < least)] = -np.inf
                best = gain.reshape(width, -1).argmax(1)
                f, b = best // bins, best % bins
                found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                at = width - 1 + np.arange(width)
                for k in np.flatnonzero(found):
                    # a split at bin b: values up to edge b go left
                    feature[t, at[k]] = f[k]
                    threshold[t, at[k]] = edges[f[k]][b[k]] if b[k] < len(edges[f[k]]) else np.inf
                node = 2 * node + (x[np.arange(n), feature[t, width - 1 + node]] > threshold[t, width - 1 + node])
            sg, sh = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
            value[t] = -rate * sg / (sh + weight)
            raw += value[t][node]
        return cls(base, feature, threshold, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, depth = np.arange(len(self.value)), int(np.log2(self.value.shape[1]))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for level in range(depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled documents outside the held-out quarter: those whose ids hash lowest.

    One row (the least text) and one label (the largest) per doc_id; null labels and ids are left out.
    """
    held = crc_mod("doc_id", 4) == 2
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of integers: a proven bound
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("text", "_label")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> BoostedTrees:
    """Fit on at most ``rows`` labelled documents (see ``labelled_sample``); features are made on the executors."""

    def run(batches):
        for batch in batches:
            made = [(statistics(t), float(y)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.float64())], ["x", "y"])

    sample = labelled_sample(docs, labels, "quality", rows).mapInArrow(run, "x binary, y double").toArrow()
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float64).reshape(-1, N_FEATURES)
    y = sample.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the same model whatever order the rows came in
    return BoostedTrees.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: BoostedTrees, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` of each row with score and predicted (1 from ``threshold`` on).

    Narrow: no shuffle.  Null and empty texts get a score too; repeated rows get
    equal scores; an empty table gives an empty result; columns not named are dropped,
    and so are kept ones that are named like the result's own.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes numbers, whatever the corpus
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, F.col("text").cast("string").alias(unused(keep)))
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        trees = sent.value
        for batch in sliced(batches):
            score = np.zeros(0)
            if batch.num_rows:
                score = trees.score(np.stack([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]))
            columns = [*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)

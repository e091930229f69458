"""Operator 8: language identification by a convolutional network over bytes.

Filters of several widths run over fixed-length windows of a text's bytes (A-Z
lower-cased), each followed by a rectifier and its maximum over the window; a
softmax layer on top.  A filter acts on one-hot bytes, so its response is a sum of
table look-ups.  Training is plain numpy: the gradient reaches only the place of
each maximum.  A text's windows are scored in batches, all of them, and their log
probabilities averaged, weighted by the letters in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, sliced, unused

WINDOW = 256
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
IS_LETTER = np.zeros(256, np.float32)
IS_LETTER[97:123] = 1
IS_LETTER[0xC3:] = 1  # first bytes of two-byte letters and beyond


def windows(text: str) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    data = text.encode().translate(LOWER)
    out = np.zeros(-(-len(data) // WINDOW) * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, WINDOW)


class ByteNetwork:
    def __init__(self, languages: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters = languages, widths, filters
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """(windows, features): the maxima; with ``where`` their places too."""
        top, at = [], []
        for w, table, bias in zip(self.widths, self.tables, self.bias):
            n = WINDOW - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : n + j]]
            if where:
                p = r.argmax(1)
                at.append(p)
                best = np.take_along_axis(r, p[:, None, :], 1)[:, 0]
            else:
                best = r.max(1)
            top.append(np.maximum(best + bias, 0))
        return (np.concatenate(top, 1), at) if where else np.concatenate(top, 1)

    def log_probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        z = np.concatenate([self.pooled(x[i : i + block]) for i in range(0, len(x), block)]) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        """Adam on cross entropy, for ``epochs`` and at least ``steps`` steps; ``y`` holds indices of languages."""
        epochs = max(epochs, -(-steps // -(-len(x) // batch)))
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                xb, yb = x[rows], y[rows]
                h, at = self.pooled(xb, where=True)
                z = h @ self.out + self.out_bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                dh = (p @ self.out.T) * (h > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                dbias = []
                cols = np.broadcast_to(np.arange(self.filters), (len(rows), self.filters))
                for m, w in enumerate(self.widths):
                    d = dh[:, m * self.filters : (m + 1) * self.filters]
                    for j in range(w):
                        np.add.at(grads[m][j], (np.take_along_axis(xb, at[m] + j, 1), cols), d)
                    dbias.append(d.sum(0))
                step += 1
                for q, g, a, b in zip(params, [*grads, *dbias, h.T @ p, p.sum(0)], first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text; ``und`` and 0 where there is no letter."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        group: list[int] = []
        size = 0

        def run():
            parts = [windows(texts[i]) for i in group]
            x = np.concatenate(parts)
            weight = IS_LETTER[x].sum(1) + 1e-3
            lp = self.log_probabilities(x) * weight[:, None]
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            mean = np.add.reduceat(lp, starts) / np.add.reduceat(weight, starts)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, row in zip(group, p):
                names[i], scores[i] = self.languages[int(row.argmax())], float(row.max())

        for i in known:
            group.append(i)
            size += len(texts[i])
            if size > 1 << 20:
                run()
                group, size = [], 0
        if group:
            run()
        return names, scores


def fit_language(docs: DataFrame, rows: int = 4_000, windows_per_text: int = 3) -> ByteNetwork:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter (those whose ids
    hash lowest, one row for each id) and at most ``windows_per_text`` of each one's windows,
    spread over the text."""
    held = crc_mod("doc_id", 4) == 2
    ids = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(~held)
    chosen = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` integers: a proven bound
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("lang is not null")
    # an id may be repeated any number of times: one of its rows, the same whatever the plan
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.col("lang").cast("string").alias("lang"), "text")).alias("one")).select("one.*")

    def run(batches):
        for batch in batches:
            x, y = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and any(map(str.isalpha, text)):
                    w = windows(text)
                    for k in sorted({*np.linspace(0, len(w) - 1, windows_per_text).astype(int).tolist()}):
                        if IS_LETTER[w[k]].sum() > 20 or len(w) == 1:
                            x.append(w[k].tobytes())
                            y.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.string())], ["x", "y"])

    got = sample.select("lang", "text").mapInArrow(run, "x binary, y string").toArrow()
    pairs = sorted(zip(got.column("y").to_pylist(), got.column("x").to_pylist()))  # one order whatever the plan
    languages = sorted({y for y, _ in pairs})
    net = ByteNetwork(languages)
    if len(languages) < 2:
        return net
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    return net.fit(x, np.array([languages.index(y) for y, _ in pairs]))


def predict_language(docs: DataFrame, net: ByteNetwork, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score.

    Narrow: no shuffle.  ``und`` with score 0 where the text is null or has no letter;
    repeated rows get equal results; an empty table gives an empty result; columns
    not named are dropped, and so are kept ones that are named like the result's own.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the corpus
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, F.col("text").cast("string").alias(unused(keep)))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in sliced(batches):
            names, scores = sent.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)

"""Quality classifier: Naive Bayes support vectors over hashed n-grams.

Indicators of words, word pairs and runs of one to three word shapes are scaled by the log ratio of their counts in
the two classes; a linear hinge-loss model is fitted to the scaled, length-normalised rows by dual coordinate descent;
a logistic curve maps its margins to probabilities.  The fit uses at most ``SAMPLE`` labelled rows; scoring reads
every whole text, in vector operations.

Defined cases: a null text is scored as the empty text; texts without words get the curve's value at the bias;
without both classes among the labels every score is the share of label 1 (0.5 without labels); rows without a label
are scored like any other; a null doc_id is never learnt from; of rows that
repeat a doc_id the least text is learnt from; other columns may have any name (rated() replaces one named score).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.labelled import SAMPLE, calibrated, remainder, sample, scored, training_rows
from symweave.llm.shared import mix, span_hashes, word_spans

BITS = 18
FOLDS, HELD = 5, 0

#: Of each byte: what stands for it in a word's shape. Letters, capitals and digits are classes, other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("9")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _runs(keys: np.ndarray, doc: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of the n-grams of keys."""
    m = len(keys) - n + 1
    if m <= 0:
        return doc[:0], doc[:0]
    h = np.full(m, seed, np.uint64)
    for k in range(n):
        h = (h + keys[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
    whole = doc[:m] == doc[n - 1 :]
    return doc[:m][whole], (mix(h[whole]) >> np.uint64(64 - BITS)).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of texts laid end to end; repeats included."""
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    shape = SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = span_hashes(shape[kept], place[starts], place[ends], 1)
    if len(words) > 1:
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        shapes = np.where(again, mix(shapes + np.uint64(7)), shapes)
    found = [_runs(words, doc, 1, 11), _runs(words, doc, 2, 12), _runs(shapes, doc, 1, 13), _runs(shapes, doc, 2, 14), _runs(shapes, doc, 3, 15)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def log_ratios(y: np.ndarray, rows: list[np.ndarray], smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
    for c, f in zip(y, rows):
        counts[int(c)][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(y: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray], cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * hinge losses, by dual coordinate descent; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y > 0).mean()])
    most = cost * 0.5 / np.maximum(share[(y > 0).astype(int)], 1e-9)
    alpha, w, bias = np.zeros(len(y)), np.zeros(1 << BITS), 0.0
    size = [float(v @ v) + 1.0 for v in values]
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = rows[i], values[i]
            slope = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


class Model:
    """Scores texts; small enough (two arrays of 2^18) to send to every worker."""

    def __init__(self, y: np.ndarray, rows: list[np.ndarray]):
        self.flat = float(y.mean()) if len(y) else 0.5
        self.trained = 0 < y.sum() < len(y)
        if not self.trained:
            return
        ratios = log_ratios(y, rows)
        values = [r / max(1e-9, np.sqrt(r @ r)) for r in (ratios[f] for f in rows)]
        test = np.arange(len(y)) % 4 == 3  # the curve is fitted to rows that the weights have not seen
        if not 0 < y[~test].sum() < (~test).sum():
            test[:] = False
        fit = np.flatnonzero(~test)
        w, self.bias = descend(y[fit], [rows[i] for i in fit], [values[i] for i in fit])
        held = np.flatnonzero(test) if test.any() else fit
        self.slope, self.shift = calibrated(np.array([w[rows[i]] @ values[i] + self.bias for i in held]), y[held])
        self.weight, self.square = (w * ratios).astype(np.float32), (ratios * ratios).astype(np.float32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.trained:
            return np.full(n, self.flat)
        doc, bucket = terms(data, offsets)
        order = np.argsort(doc, kind="stable")
        doc, bucket = doc[order], bucket[order]
        cut = np.searchsorted(doc, np.arange(n + 1))
        mark, count, margin = np.zeros(1 << BITS, np.int64), np.arange(len(bucket)), np.zeros(n)
        for k in range(n):
            b, c = bucket[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]]
            mark[b] = c
            b = b[mark[b] == c]  # each term once
            norm = np.sqrt(self.square[b].sum(dtype=float))
            margin[k] = self.weight[b].sum(dtype=float) / max(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD, most: int = SAMPLE) -> Model:
    """Learns from labelled documents whose crc32 remainder is not `held`."""
    left = remainder(F.col("doc_id"), folds)
    return Model(*training_rows(docs, sample(labels, label, (left != held) & (left >= 0), most), terms))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs[text], lambda data, offsets: sent.value(data, offsets))


def rated(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, in place of a column of that name."""
    return docs.withColumn("score", score(docs, model, text))

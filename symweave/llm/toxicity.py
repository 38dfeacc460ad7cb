"""Toxicity: a factorization machine over hashed terms.

Terms are words (letters and digits, lower case) and word stems of four to six bytes, hashed.  Each term that the model keeps has a linear weight and a
vector of factors; the inner product of two terms' vectors is the weight of their meeting in one document, so an insult next to a group mention can
count for more than both alone, or undo what both say.  Fitted by adaptive gradient steps on the logistic loss of at most ``SAMPLE`` labelled rows;
scoring reads every whole text.

The model keeps a term that tells alone, by a chi-square of ``least`` or more of its presence against the label, and a term that tells in a pair: two
terms of which each stands in one of ``often`` labelled rows or more, and whose meetings hold label 1 otherwise than the log-odds of both add up to,
by a chi-square of ``paired`` or more.  Pairs are counted over all such terms in tiles of ``TILE`` terms.  The thresholds are part of the model, like the number of
factors; how many terms pass them is not bounded.  Of a pair of rarer terms each tells a little alone where the pair tells anything, unless their
meetings and the rest cancel.

Defined cases: a null text is scored as the empty text; a text without known terms gets the bias alone; without both
classes among the labels every score is the share of label 1 (0 without labels); a null doc_id is never learnt from;
of rows that repeat a doc_id the least text is learnt from; other columns may have any name (rated() replaces one named score).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.labelled import remainder, sample, scored, training_rows
from symweave.llm.quality import LOWER
from symweave.llm.shared import mix, span_hashes, word_spans

BITS, FACTORS, STEMS = 22, 8, (4, 5, 6)
#: A chi-square of LEAST comes by chance once in a hundred, one of PAIRED once in 10^7, as there are many pairs.
LEAST, PAIRED, OFTEN, TILE = 6.6, 30.0, 20, 512
FOLDS, HELD = 4, 2
#: Labelled rows that the model is fitted on at most.
SAMPLE = 16384
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of texts laid end to end; repeats included."""
    starts, ends, doc = word_spans(data, offsets, LETTERS)
    data = LOWER[data]
    words = span_hashes(data, starts, ends)
    docs, keys = [doc], [words]
    for n in STEMS:
        long = ends - starts > n
        docs.append(doc[long])
        keys.append(mix(span_hashes(data, starts[long], starts[long] + n, n)))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def telling(y: np.ndarray, rows: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Buckets whose presence against the label has a chi-square of `least` or more; each in two rows or more, as one row shows no repetition."""
    seen, hits = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for c, f in zip(y, rows):
        seen[f] += 1
        hits[f] += c
    n, ones = len(y), y.sum()
    due = seen * ones / n
    chi = (hits - due) ** 2 / np.maximum(due, 1e-9) + (hits - due) ** 2 / np.maximum(seen - due, 1e-9)
    return np.flatnonzero((seen > 1) & (chi > least))


def pairing(y: np.ndarray, rows: list[np.ndarray], often: int = OFTEN, paired: float = PAIRED) -> np.ndarray:
    """Buckets, each in one of `often` rows or more, that meet another such one with label 1 otherwise than their log-odds add up to.

    Memory is that of two tiles of TILE terms by all rows, beside the terms of the rows.
    """
    seen, hits = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS)
    for c, f in zip(y, rows):
        seen[f] += 1
        hits[f] += c
    common = np.flatnonzero(seen * often >= max(len(y), 1))
    place = np.full(1 << BITS, -1, np.int32)
    place[common] = np.arange(len(common))
    own = [p[p >= 0] for p in (place[f] for f in rows)]
    row, term = np.repeat(np.arange(len(own)), [len(p) for p in own]), np.concatenate([*own, np.zeros(0, np.int32)])
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]

    def tile(k: int) -> np.ndarray:
        a, b = np.searchsorted(term, (k, k + TILE))
        out = np.zeros((len(y), min(TILE, len(common) - k)), np.float32)
        out[row[a:b], term[a:b] - k] = 1
        return out

    share = (hits[common] + 0.5) / (seen[common] + 1)
    odds, base = np.log(share / (1 - share)), np.log(y.mean() / (1 - y.mean()))
    found = np.zeros(len(common), bool)
    for i in range(0, len(common), TILE):
        left = tile(i)
        ones = left * y[:, None].astype(np.float32)
        for j in range(i, len(common), TILE):
            right = left if i == j else tile(j)
            met, hit = left.T @ right, ones.T @ right
            due = 1 / (1 + np.exp(base - odds[i : i + TILE, None] - odds[None, j : j + TILE]))
            tells = (hit - met * due) ** 2 / (met * due * (1 - due) + 1) > paired
            if i == j:
                np.fill_diagonal(tells, False)
            found[i : i + TILE] |= tells.any(1)
            found[j : j + TILE] |= tells.any(0)
    return common[found]


def train(y: np.ndarray, rows: list[np.ndarray], size: int, rounds: int = 16, rate: float = 0.5, slow: float = 0.05, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors.  Weights move at `rate`, bias and factors at `slow`: pairs explain what single terms leave open."""
    rng = np.random.default_rng(11)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            f = rows[i]
            own = v[f]
            total = own.sum(0)
            z = bias + w[f].sum() + 0.5 * (total @ total - (own * own).sum())
            slope = 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) - y[i]
            gb += slope * slope
            bias -= slow * slope / np.sqrt(gb)
            if len(f):
                step = slope + decay * w[f]
                gw[f] += step * step
                w[f] -= rate * step / np.sqrt(gw[f])
                step = slope * (total - own) + decay * own
                gv[f] += step * step
                v[f] -= slow * step / np.sqrt(gv[f])
    return bias, w, v


class Model:
    """Scores texts; a table of 2^22 small numbers and the weights of the terms that are kept."""

    def __init__(self, y: np.ndarray, rows: list[np.ndarray], least: float = LEAST, often: int = OFTEN, paired: float = PAIRED):
        self.flat = float(y.mean()) if len(y) else 0.0
        self.trained = 0 < y.sum() < len(y)
        if self.trained:
            best = np.union1d(telling(y, rows, least), pairing(y, rows, often, paired))
            self.place = np.full(1 << BITS, -1, np.int16 if len(best) < 1 << 15 else np.int32)
            self.place[best] = np.arange(len(best))
            self.bias, self.weight, self.factors = train(y, [p[p >= 0] for p in (self.place[f] for f in rows)], len(best))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.trained:
            return np.full(n, self.flat)
        doc, bucket = terms(data, offsets)
        term = self.place[bucket]
        known = term >= 0
        size = max(1, len(self.weight))
        pairs = np.unique(doc[known] * size + term[known])  # each term of a document once
        doc, term = pairs // size, pairs % size
        z = self.bias + np.bincount(doc, self.weight[term], n)
        for k in range(FACTORS):
            own = self.factors[term, k]
            z += 0.5 * (np.bincount(doc, own, n) ** 2 - np.bincount(doc, own * own, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, most: int = SAMPLE, least: float = LEAST, often: int = OFTEN, paired: float = PAIRED) -> Model:
    """Learns from at most `most` labelled documents whose crc32 remainder is not `held`."""
    left = remainder(F.col("doc_id"), folds)
    return Model(*training_rows(docs, sample(labels, label, (left != held) & (left >= 0), most), terms), least, often, paired)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs[text], lambda data, offsets: sent.value(data, offsets))


def rated(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, in place of a column of that name."""
    return docs.withColumn("score", score(docs, model, text))

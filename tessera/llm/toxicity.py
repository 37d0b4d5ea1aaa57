"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words (runs of letters and other non-ASCII
bytes) and their beginnings of 4, 6 and 8 bytes, each by a 64-bit hash. A term
that the model knows has a weight and a vector; the score of a text is the
logistic of the bias, the weights of its distinct terms and the inner products
of all pairs of their vectors, so that two terms together can count for more, or
less, than the sum of both.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled texts of
each label outside the held-out fold, whole texts. Known terms are those that
occur in ``MIN_TEXTS`` sampled texts and tell the labels apart best, at most
``TERMS``; scoring finds them in a table of hash slots that also holds the rest
of the hash, so an unknown word is not taken for a known one.

Defined cases: a null or empty text has no term and gets the bias's score;
repeated rows get equal scores; null ids are kept; further columns are not read;
empty tables give empty results. With labels of one value only, or none, every
score is the share of label 1 with one pseudo-count of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .labelled import score_rows, sigmoid, training_sample
from .tokens_np import LOWER, U, hashes, mix, parts

PER_CLASS, MIN_TEXTS, TERMS, RANK = 2500, 3, 1 << 13, 6
EPOCHS, BATCH, SLOTS = 12, 64, 1 << 18
FOLDS, HELD_OUT, LIMIT = 4, 2, 0.3
BEGINNINGS = (4, 6, 8)

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of runs of letters, data lower-cased; a separator stands between rows, so no run crosses."""
    inside = np.concatenate([[False], LETTER[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    # rows are joined without a separator: cut runs at the offsets
    inner = offsets[1:-1]
    at = np.searchsorted(starts, inner, "left") - 1
    cut = np.unique(inner[(at >= 0) & (inner < ends[np.maximum(at, 0)])]) if len(starts) else inner[:0]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def terms(texts: pa.Array):
    """(first row, rows, hash of each term, its row); terms repeat as they do in the text."""
    for base, data, offsets in parts(texts):
        data = LOWER[data]
        starts, ends, row = letter_runs(data, offsets)
        found, rows = [hashes(data, starts, ends)], [row]
        for n in BEGINNINGS:
            long = np.flatnonzero(ends - starts >= n)
            found.append(mix(hashes(data, starts[long], starts[long] + n) ^ U(n)))
            rows.append(row[long])
        yield base, len(offsets) - 1, np.concatenate(found), np.concatenate(rows)


class Model:
    def __init__(self, bias: float = 0.0):
        self.bias, self.weights, self.vectors = bias, np.zeros(1, np.float32), np.zeros((1, RANK), np.float32)
        self.rest, self.slot_term = np.zeros(SLOTS, U), np.full(SLOTS, -1, np.int32)

    def known(self, found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, row) of distinct known terms, by row."""
        slot = (found & U(SLOTS - 1)).astype(np.int64)
        hit = np.flatnonzero((self.rest[slot] == found) & (self.slot_term[slot] >= 0))
        both = np.unique(row[hit] * TERMS + self.slot_term[slot[hit]])
        return both % TERMS, both // TERMS

    def raw(self, term: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score before the logistic, sum of vectors) of each of n rows."""
        total = np.stack([np.bincount(row, self.vectors[term, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, (self.vectors[term] ** 2).sum(1), n)
        return self.bias + np.bincount(row, self.weights[term], n) + 0.5 * ((total**2).sum(1) - squares), total

    def fit(self, texts: pa.Array, y: np.ndarray, log_odds: float, seed: int = 5) -> Model:
        if not 0 < y.sum() < len(y):
            self.bias = log_odds
            return self
        hashed, rows = [], []
        for base, _, found, row in terms(texts):
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            hashed.append(found[new])
            rows.append(row[new] + base)
        names, which = np.unique(np.concatenate(hashed), return_inverse=True)
        row = np.concatenate(rows)
        self._choose(names, np.bincount(which), np.bincount(which, y[row]), y)
        # the chosen terms of every text, by text
        slot = (names & U(SLOTS - 1)).astype(np.int64)
        to = np.where(self.rest[slot] == names, self.slot_term[slot], -1)[which]
        row, term = row[to >= 0], to[to >= 0]
        begins = np.searchsorted(row, np.arange(len(y) + 1))
        r = np.random.default_rng(seed)
        self.vectors = r.normal(0, 0.05, self.vectors.shape)
        self.bias, past_w, past_v, past_b = 0.0, np.full(len(self.weights), 1e-6), np.full(self.vectors.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                take = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in own])
                of, t = np.repeat(np.arange(len(own)), begins[own + 1] - begins[own]), term[take]
                score, total = self.raw(t, of, len(own))
                g = sigmoid(score) - y[own]
                gw = np.bincount(t, g[of], len(self.weights)) + 0.02 * self.weights * (np.bincount(t, minlength=len(self.weights)) > 0)
                gv = np.zeros_like(self.vectors)
                np.add.at(gv, t, g[of][:, None] * (total[of] - self.vectors[t]))
                seen = np.unique(t)
                gv[seen] += 0.05 * self.vectors[seen]
                past_w += gw**2
                past_v += gv**2
                past_b += g.sum() ** 2
                self.weights = self.weights - 0.1 * gw / np.sqrt(past_w)
                self.vectors = self.vectors - 0.03 * gv / np.sqrt(past_v)
                self.bias -= 0.1 * g.sum() / np.sqrt(past_b)
        self.bias += log_odds - float(np.log(y.sum() / (len(y) - y.sum())))
        self.weights, self.vectors = self.weights.astype(np.float32), self.vectors.astype(np.float32)
        return self

    def _choose(self, names: np.ndarray, df: np.ndarray, pos: np.ndarray, y: np.ndarray) -> None:
        """Terms by the chi-square of their texts' labels; of those that share a slot the best stays."""
        p, n = y.sum(), len(y)
        neg, q = df - pos, n - y.sum()
        other = np.maximum(n - df, 1)
        chi = n * (pos * (q - neg) - neg * (p - pos)) ** 2 / (df * other * p * q)
        best = np.flatnonzero(df >= MIN_TEXTS)
        best = best[np.lexsort((names[best], -chi[best]))][:TERMS]
        self.weights, self.vectors = np.zeros(max(1, len(best))), np.zeros((max(1, len(best)), RANK))
        for term, i in list(enumerate(best))[::-1]:
            slot = int(names[i] & U(SLOTS - 1))
            self.rest[slot], self.slot_term[slot] = names[i], term

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, n, found, row in terms(texts):
            out.append(sigmoid(self.raw(*self.known(found, row), n)[0]))
        return np.concatenate(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return Model().fit(*training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score_rows(docs, fit_toxicity(docs, labels, per_class).scores, LIMIT, FOLDS, HELD_OUT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

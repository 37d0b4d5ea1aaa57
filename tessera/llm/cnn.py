"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of 512 bytes that overlap by half and cover it whole.
Filters over six bytes slide over every byte; each chunk keeps every filter's
maximum, a small dense layer reads those, and the mean and the maximum of its
outputs over all chunks of the text give one probability. A filter is a table of
six weights per byte value, learned by gradient descent; for scoring, tables are
added up pairwise so that a filter bank costs three look-ups a byte.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled texts of
each label outside the held-out fold (fewer where their bytes pass ``FIT_BYTES``),
every chunk of each, as scoring reads them. The balanced sample's log odds are corrected to
those of all labels.

Defined cases: a null or empty text is one chunk of padding and is scored like
any other; repeated rows get equal scores; null ids are kept; further columns
are not read; empty tables give empty results. With labels of one value only, or
none, every score is the share of label 1 with one pseudo-count of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches
from .labelled import score_rows, sigmoid, training_sample
from .tokens_np import parts

HALF, WIDTH, FILTERS, HIDDEN = 256, 6, 16, 12
PER_CLASS, EPOCHS, BATCH = 1500, 8, 64
FOLDS, HELD_OUT, LIMIT = 3, 1, 0.5


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole half-chunks (two at least, and room for the last filter position): (bytes, first half-chunk of each text)."""
    lengths = np.diff(offsets)
    halves = np.maximum(2, -(-(lengths + WIDTH) // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    if len(data):
        shift = first[:-1] * HALF - offsets[:-1]
        out[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    return out, first


def pair_tables(filters: np.ndarray) -> list[np.ndarray]:
    """(WIDTH, 256, FILTERS) to three tables of two bytes each."""
    return [(filters[k][:, None] + filters[k + 1][None]).reshape(65536, -1).astype(np.float32) for k in range(0, WIDTH, 2)]


def half_maxima(data: np.ndarray, first: np.ndarray, tables: list[np.ndarray], block: int = 64) -> np.ndarray:
    """Every filter's maximum over each half-chunk. At the end of a text a filter sees padding, never the next text."""
    padding = sum(t[0] for t in tables)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    pairs = data[:-1].astype(np.int32) * 256 + data[1:]
    n = (len(data) - WIDTH) // HALF
    out = np.empty((n, tables[0].shape[1]), np.float32)
    for at in range(0, n, block):
        lo, hi = at * HALF, min(at + block, n) * HALF
        y = tables[0].take(pairs[lo:hi], 0)
        y += tables[1].take(pairs[lo + 2 : hi + 2], 0)
        y += tables[2].take(pairs[lo + 4 : hi + 4], 0)
        y = y.reshape(-1, HALF, y.shape[1])
        y[last[at : at + block], HALF - WIDTH + 1 :] = padding
        out[at : at + block] = y.max(1)
    return out


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "filters": r.normal(0, 0.3, (WIDTH, 256, FILTERS)),
            "bias": np.zeros(FILTERS),
            "dense": r.normal(0, 0.4, (FILTERS, HIDDEN)),
            "dense_bias": np.zeros(HIDDEN),
            "out": r.normal(0, 0.2, 2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.shift = 0.0

    def head(self, pooled: np.ndarray, text: np.ndarray, n: int) -> dict:
        """pooled: filter maxima by chunk; text: the text of each chunk, ascending, each of n at least once."""
        p = self.p
        x = np.maximum(pooled + p["bias"], 0)
        a = np.maximum(x @ p["dense"] + p["dense_bias"], 0)
        first = np.searchsorted(text, np.arange(n))
        count = np.bincount(text, minlength=n)[:, None]
        mean, top = np.add.reduceat(a, first, 0) / count, np.maximum.reduceat(a, first, 0)
        return {"x": x, "a": a, "count": count, "mean": mean, "top": top, "logit": np.hstack([mean, top]) @ p["out"] + p["out_bias"][0]}

    def fit(self, texts: pa.Array, y: np.ndarray, log_odds: float, seed: int = 11) -> Model:
        if not 0 < y.sum() < len(y):
            self.p["out"][:] = 0
            self.shift = log_odds
            return self
        laid_out, starts, ends, owner, at = [], [], [], [], 0
        for row, data, offsets in parts(texts):
            laid, first = layout(data, offsets)
            inside = np.ones(first[-1], bool)
            inside[first[1:] - 1] = False  # a chunk does not reach into the next text
            half = np.flatnonzero(inside)
            starts.append(at + half * HALF)
            ends.append(~inside[half + 1])
            owner.append(row + np.repeat(np.arange(len(first) - 1), np.diff(first) - 1))
            laid_out.append(laid)
            at += len(laid)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(laid_out), 2 * HALF + WIDTH)
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        begins = np.searchsorted(owner, np.arange(len(y) + 1))
        r, state, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                take = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in rows])
                text = np.repeat(np.arange(len(rows)), begins[rows + 1] - begins[rows])
                step += 1
                rate = 0.02 * (0.5 if epoch >= EPOCHS - 3 else 1) * (0.4 if epoch == EPOCHS - 1 else 1)
                chunks = windows[starts[take]]
                chunks[ends[take], 2 * HALF :] = 0
                self._update(self._gradients(chunks, text, y[rows]), state, step, rate)
        self.shift = log_odds - float(np.log(y.sum() / (len(y) - y.sum())))
        return self

    def _gradients(self, chunks: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, len(y)
        tables = pair_tables(p["filters"])
        pooled, where = np.empty((len(chunks), FILTERS)), np.empty((len(chunks), FILTERS), np.int64)
        for at in range(0, len(chunks), 32):
            own = chunks[at : at + 32]
            own = own[:, :-1].astype(np.int32) * 256 + own[:, 1:]
            v = sum(t.take(own[:, 2 * k : 2 * k + 2 * HALF], 0) for k, t in enumerate(tables))
            where[at : at + 32] = v.argmax(1)
            pooled[at : at + 32] = np.take_along_axis(v, where[at : at + 32][:, None], 1)[:, 0]
        h = self.head(pooled, text, n)
        g = (sigmoid(h["logit"]) - y) / n
        d = np.outer(g, p["out"])
        d_mean, d_top = d[:, :HIDDEN] / h["count"], d[:, HIDDEN:]
        hits = h["a"] == h["top"][text]
        ties = np.maximum(np.add.reduceat(hits.astype(float), np.searchsorted(text, np.arange(n)), 0), 1)
        da = (d_mean[text] + hits * (d_top / ties)[text]) * (h["a"] > 0)
        dx = (da @ p["dense"].T) * (h["x"] > 0)
        d_filters, f = np.empty_like(p["filters"]), np.arange(FILTERS)
        for k in range(WIDTH):
            byte = np.take_along_axis(chunks, where + k, 1).astype(np.int64)
            d_filters[k] = np.bincount((byte * FILTERS + f).ravel(), dx.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return {"filters": d_filters, "bias": dx.sum(0), "dense": h["x"].T @ da, "dense_bias": da.sum(0), "out": np.hstack([h["mean"], h["top"]]).T @ g, "out_bias": np.array([g.sum()])}

    def _update(self, grads: dict, state: dict, step: int, rate: float) -> None:
        for k, g in grads.items():
            g = g + 1e-5 * self.p[k]
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def scores(self, texts: pa.Array) -> np.ndarray:
        tables, out = pair_tables(self.p["filters"]), [np.zeros(0)]
        for _, data, offsets in parts(texts):
            laid, first = layout(data, offsets)
            halves = half_maxima(laid, first, tables)
            pooled = np.maximum(halves[:-1], halves[1:])
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:-1]
            inside = np.ones(len(pooled), bool)
            inside[first[1:-1] - 1] = False  # a chunk does not reach into the next text
            out.append(sigmoid(self.head(pooled[inside], text[inside], len(first) - 1)["logit"] + self.shift))
        return np.concatenate(out)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return Model().fit(*training_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score_rows(docs, fit_quality(docs, labels, per_class).scores, LIMIT, FOLDS, HELD_OUT)


def keep_rows(docs: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows, whole and with all their columns, whose text scores at least ``limit``; one pass, no join."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(batch.schema.get_field_index(text))) >= limit))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

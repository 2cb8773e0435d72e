"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import texts
from sievekit.llm.labelled import calibrate, fold, learn, sample, sigmoid

#: Hashed word features, rank of the interactions, bins of a statistic.
WORDS, RANK, BINS = 1 << 15, 8, 8
#: Labelled documents of each label that are learned from at most.
PER_LABEL = 1500

STATISTICS = ("length", "words", "word_length", "upper", "digits", "marks", "bars", "symbols", "shouts", "lines", "distinct", "most", "repeats", "accents")

_UPPER, _DIGIT, _MARK, _BAR, _SYMBOL, _SHOUT, _LINE, _HIGH = (np.zeros(256, bool) for _ in range(8))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in ".,;:?"]] = True
_BAR[[ord(c) for c in "|<>{}[]"]] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~_=+\\/"]] = True
_SHOUT[ord("!")] = True
_LINE[10] = True
_HIGH[128:] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows x len(STATISTICS)); and the rows' distinct hashed words: row, feature, value (rows of length one)."""
    n = len(offs) - 1
    starts, ends, rows = textscan.words(data, offs)
    size, count = np.diff(offs), np.diff(rows)
    row = np.repeat(np.arange(n), count)
    hashes = textscan.word_hashes(textscan.lower_ascii(data), starts, ends)
    some, some_words = np.maximum(size, 1), np.maximum(count, 1)

    def share(chosen: np.ndarray, of: np.ndarray = some) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(chosen[data])])[offs]) / of

    codes, distinct = pd.factorize(hashes)
    pairs = pd.factorize(row * max(len(distinct), 1) + codes)
    times = np.bincount(pairs[0], minlength=len(pairs[1]))
    owner = pairs[1] // max(len(distinct), 1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, times)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats = np.stack([
        np.log1p(size), np.log1p(count), (size - count) / some_words, share(_UPPER), share(_DIGIT), share(_MARK, some_words), share(_BAR, some_words), share(_SYMBOL, some_words),
        share(_SHOUT, some_words), share(_LINE, some_words), np.bincount(owner, minlength=n) / some_words, most / some_words, np.bincount(row, again, n) / some_words, share(_HIGH),
    ], axis=1)
    feature = (distinct[pairs[1] % max(len(distinct), 1)] >> np.uint64(13)).astype(np.int64) % WORDS
    # words of one row that share a feature are one feature: the machine's identity needs each once
    key = owner * WORDS + feature
    where, own = pd.factorize(key)
    value = np.log1p(np.bincount(where, times, len(own)))
    owner, feature = own // WORDS, own % WORDS
    norm = np.sqrt(np.bincount(owner, value * value, n))
    return stats, owner, feature, value / norm[owner] if len(owner) else value


@dataclass
class Model:
    """score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, then the calibration."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of all features, sorted by row."""
        stats, owner, feature, value = features(data, offs)
        n, k = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], axis=1) + np.arange(k) * (BINS + 1) + WORDS
        row = np.concatenate([owner, np.repeat(np.arange(n), k)])
        feature = np.concatenate([feature, bins.ravel()])
        value = np.concatenate([value, np.full(n * k, 1 / np.sqrt(k))])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], value[order]

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Pairs in linear time: half the difference of the squared sum and the sum of squares."""
        first = np.flatnonzero(np.diff(row, prepend=-1))  # each row has its statistics, so none is missing
        xv = self.v[feature] * value[:, None].astype(np.float32)
        sums = np.add.reduceat(xv, first, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), first)
        return self.w0 + np.add.reduceat(self.w[feature] * value, first) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(*self.rows(data, offs)) + self.intercept)


def train(sentences: list[str], y: np.ndarray, prior: float | None = None, rounds: int = 12, rate: float = 0.1, ridge: float = 2e-4, seed: int = 3) -> Model:
    """Learn from labelled texts by AdaGrad over small batches; the calibration comes from texts that were set aside.

    prior: the share of label 1 among all labelled rows, where the texts are a sample balanced otherwise.
    """
    k = len(STATISTICS)
    data, offs = textscan.buffer_of(pa.array(sentences, pa.string()))
    size = WORDS + k * (BINS + 1)
    random = np.random.default_rng(seed)
    chunks = list(textscan.row_chunks(offs))
    stats = np.concatenate([features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[0] for a, b in chunks]) if chunks else np.zeros((0, k))
    edges = np.stack([np.quantile(stats[:, j], np.linspace(0, 1, BINS + 2)[1:-1]) if len(stats) else np.zeros(BINS) for j in range(k)])
    model = Model(edges, 0.0, np.zeros(size), (random.standard_normal((size, RANK)) * 0.05).astype(np.float32))
    if not len(y) or y.min() == y.max():
        model.intercept, model.slope = (5.0 if len(y) and y[0] > 0 else -5.0 if len(y) else 0.0), 0.0
        return model
    parts = []
    for a, b in chunks:
        row, feature, value = model.rows(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        parts.append((row + a, feature, value))
    row, feature, value = (np.concatenate(x) for x in zip(*parts))
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    aside = random.random(len(y)) < 0.2
    learn = np.flatnonzero(~aside)
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        for batch in np.array_split(random.permutation(learn), max(1, len(learn) // 32)):
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in batch.tolist()])
            own = np.repeat(np.arange(len(batch)), begin[batch + 1] - begin[batch])
            f, x = feature[at], value[at]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            xv = model.v[f] * x[:, None].astype(np.float32)
            sums = np.add.reduceat(xv, first, axis=0)
            z = model.w0 + np.add.reduceat(model.w[f] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), first))
            error = (sigmoid(z) - y[batch]) / len(batch)
            each = error[own] * x
            touched, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, each, len(touched)) + ridge * model.w[touched]
            slope = (each[:, None] * (sums[own] - xv)).astype(np.float32)
            dv = np.stack([np.bincount(place, slope[:, r], len(touched)) for r in range(RANK)], axis=1).astype(np.float32) + ridge * model.v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            model.w[touched] -= rate * dw / np.sqrt(gw[touched])
            model.v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
            g0 += error.sum() ** 2
            model.w0 -= rate * error.sum() / np.sqrt(g0)
    raw = model.raw(row, feature, value)
    test = aside if aside.any() and y[aside].min() < y[aside].max() else ~aside
    model.slope, model.intercept = calibrate(raw[test], y[test])
    if prior is not None and 0 < prior < 1:
        seen = y[test].mean()
        model.intercept += float(np.log(prior / (1 - prior)) - np.log(seen / (1 - seen)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score from 0 to 1 (higher: more likely of quality) for each row; a null text counts as empty.

    Repeated rows and null ids are kept, other columns are ignored, an empty table gives an empty table.  Whole texts are
    read, whatever their length.  The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for lo, hi in textscan.row_chunks(offs):
                value = shared.value.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, per_label: int = PER_LABEL) -> Model:
    """The model of the labelled documents outside fold 0, of at most `per_label` of either label."""
    shown = labels.filter(fold("doc_id", folds) != 0).filter("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    return learn(sample(documents, labels, "quality", folds, per_label), lambda texts_, y: train(texts_, y, prior=shown))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    out = score(documents, fit(documents, labels, folds))
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Labelled rows to learn from, and a few shared parts of the two classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import small_batches


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id's decimal text modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(documents: DataFrame, labels: DataFrame, label_col: str, folds: int, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y, text: at most `per_label` documents of each label, those with the smallest hashes of their ids.

    Rows of fold 0, and rows whose label or id is null, are left out; of several labels of a document the largest counts, of
    several texts the smallest.  The bound is on what one machine fits; everything else about the corpus is counted elsewhere.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(fold("id", folds) != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.filter("y = 0").orderBy(F.xxhash64("id"), "id").limit(per_label).union(known.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(per_label))
    found = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most 2 * per_label rows of two numbers: small whatever the corpus
    return found.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def learn(rows: DataFrame, train: Callable[[list[str], np.ndarray], object]):
    """train(texts, labels) of the sampled rows, in the order of their ids, run by one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, y, text) for batch in batches for i, y, text in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "text"))))
        model = train([text for _, _, text in found], np.array([y for _, y, _ in found], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    small_batches(rows.sparkSession)
    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else train([], np.zeros(0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(raw: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """a, b for which sigmoid(a * raw + b) fits the labels best, by Newton steps with a small ridge (Platt, 1999)."""
    if not len(raw):
        return 1.0, 0.0
    # smoothed targets keep a finite optimum where the labels are separable
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([raw, np.ones_like(raw)], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - target) + 1e-6 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])

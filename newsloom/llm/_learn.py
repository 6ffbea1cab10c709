"""Small numpy pieces of the trained models: Adam, logistic regression, and the labelled sample."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import documents_of, fold

if TYPE_CHECKING:  # workers of Arrow functions don't need it
    import pandas as pd


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 1e-4):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = np.clip(g, -5, 5) + self.decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.p[k].dtype)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (last: bias) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + l2 * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w


#: Of a training text longer than PIECES * PIECE code points, so many pieces of so many, spread evenly over the whole text.
PIECES, PIECE = 256, 1024


def spread(text: Column, pieces: int = PIECES, piece: int = PIECE) -> Column:
    """The text, or for one longer than the pieces together, evenly spaced pieces of it as lines, the first and the last included."""
    apart = (F.length(text) - piece) / (pieces - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (F.floor(i * apart) + 1).cast("int"), F.lit(piece)))
    return F.when(F.length(text) > pieces * piece, F.array_join(cut, "\n")).otherwise(text)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, label: documents with a text and a label of 0 or 1 outside the held-out fold, once each (the larger label)."""
    lab = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    lab = lab.where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    return lab.join(documents_of(docs).where(F.length("text") > 0).select("doc_id"), "doc_id", "left_semi")


def texts_of(docs: DataFrame, chosen: DataFrame) -> pd.DataFrame:
    """doc_id, text, label of the chosen documents (a number of rows that a parameter bounds). Of repeated rows of an id the smallest text trains."""
    rows = documents_of(docs).join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0).withColumn("text", spread(F.col("text")))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas().sort_values("doc_id", ignore_index=True)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: tuple[int, int]) -> pd.DataFrame:
    """doc_id, text, label: at most most[0] and most[1] documents labelled 0 and 1, the first by hash of the id, whatever their length."""
    lab = labelled(docs, labels, label, folds, held_out)
    first = [lab.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in enumerate(most)]
    return texts_of(docs, first[0].unionByName(first[1]))

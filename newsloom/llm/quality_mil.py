"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, runs of PASSAGE words over the whole text. Each passage is encoded from measures of
its characters and words; gated attention weighs the encodings, and the weighted sum is scored. Only documents have
labels: encoder, attention and score are trained together from them, in numpy, on a bounded sample.

Defined cases: a null or empty text, or one without words, is one passage of zeros; without labels of both kinds
every score is the share of label 1 (0.5 without any label); repeated rows get the same score; extra columns and the
columns lang, source and doc_id are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm._learn import Adam, sample, sigmoid
from newsloom.llm._shared import batch_of, documents_of, fold, lean, mix, range_hashes, steps, words

#: Documented bound of the training sample: documents of label 0 and 1 (of any length; ``_learn.spread`` bounds what is read of one).
SAMPLE = (700, 1000)
FOLDS, HELD_OUT = 4, 2
PASSAGE, HIDDEN, GATE, EPOCHS, CUT = 48, 16, 12, 60, 0.7
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>", "pipe": b"|", "stop": b".,;:?", "bang": b"!", "other": b"=@^~_{}[]\\/+\"'()-", "high": range(128, 256)}
KIND = np.zeros(256, np.int64)
for _n, _members in enumerate(_CLASSES.values(), 1):
    KIND[list(_members)] = _n
N_FEATURES = 2 * len(_CLASSES) + 9


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and the offsets of the documents into them; each document has one at least."""
    n = len(offs) - 1
    ws, we, row = words(data, offs)
    first = np.searchsorted(row, np.arange(n + 1))
    per = np.maximum(1, -(-np.diff(first) // PASSAGE))
    ends = np.r_[0, np.cumsum(per)]
    out = np.zeros((ends[-1], N_FEATURES), np.float32)
    if not len(ws):
        return out, ends
    of = ends[row] + (np.arange(len(ws)) - first[row]) // PASSAGE  # passage of each word
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    at, count = of[starts], np.diff(np.r_[starts, len(ws)]).astype(np.float64)
    a, b = ws[starts], we[np.r_[starts[1:], len(ws)] - 1]
    size = (we - ws).astype(np.float64)
    chars = np.add.reduceat(size, starts)
    kind = KIND[data]
    shares = []
    for k in range(1, len(_CLASSES) + 1):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=c[1:])
        shares.append((c[b] - c[a]) / chars)
    shares = np.stack(shares, 1)
    h = range_hashes(data, ws, we)
    same = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
    inside = mix(h ^ mix(of.astype(np.uint64) + np.uint64(9)))
    _, distinct = np.unique(inside, return_index=True)
    fresh = np.zeros(len(ws))
    fresh[distinct] = 1
    salt = mix(row.astype(np.uint64) + np.uint64(5))
    pair = mix(mix(h[1:]) + h[:-1] * np.uint64(3) ^ salt[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    again = np.r_[False, (times[back] > 2) & (row[1:] == row[:-1])]  # word pairs that the document has three times or more
    mean = lambda x: np.add.reduceat(x.astype(np.float64), starts) / count
    length = mean(size)
    more = [mean(same), mean(same) > 0.15, mean(fresh), mean(again), length / 10, np.sqrt(np.maximum(0, mean(size**2) - length**2)) / 10, np.log1p(count) / 4, mean(KIND[data[we - 1]] == 6), np.ones(len(starts))]
    out[at] = np.concatenate([np.minimum(shares * 4, 4), shares > 0.06, np.stack(more, 1)], 1)
    return out, ends


class Mil:
    """Encoder, gated attention and score: the parameters and their gradients."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, constant: float | None = None):
        self.p, self.mean, self.scale, self.constant = p, mean, scale, constant

    def forward(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, starts = self.p, ends[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        size = np.diff(ends)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        alpha = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return z @ p["c"] + p["d"][0], (x, h, t, g, alpha, z, size)

    def score(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ends) - 1, self.constant)
        return sigmoid(self.forward(x, ends)[0]).astype(np.float64)

    def gradients(self, x: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (x, h, t, g, alpha, z, size) = self.forward(x, ends)
        dl = (sigmoid(logit) - y) * weight / weight.sum()
        dz = np.repeat(dl[:, None] * p["c"], size, 0)
        d_alpha = (dz * h).sum(1)
        de = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, ends[:-1]), size))
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}


def fit(x: np.ndarray, ends: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Mil:
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": small(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": small(HIDDEN, GATE), "u": small(HIDDEN, GATE), "a": small(GATE), "c": small(HIDDEN), "d": np.zeros(1)}
    model = Mil(p, x.mean(0), x.std(0) + 0.05)
    adam, n = Adam(p, 0.01, 1e-3), len(y)
    size = np.diff(ends)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            bag = order[at : at + 64]
            take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in bag])
            adam.step(model.gradients(x[take], np.r_[0, np.cumsum(size[bag])], y[bag], np.ones(len(bag))))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Mil:
    """Learns from labels.quality of documents outside the held-out fold, within the documented sample."""
    rows = sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE)
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Mil({}, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.5)
    xs, sizes = [], []
    for _, data, offs in steps(pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.large_string())], names=["text"])):
        x, ends = passages(data, offs)
        xs.append(x)
        sizes.append(np.diff(ends))
    return fit(np.concatenate(xs).astype(float), np.r_[0, np.cumsum(np.concatenate(sizes))], y)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Mil) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in steps(batch):
                yield batch_of(SCORED, doc_id=part["doc_id"], score=model.score(*passages(data, offs)))

    return documents_of(docs).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Mil) -> DataFrame:
    """The documents whose score is at least CUT, with all their columns; no join, so nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in steps(batch):
                good = model.score(*passages(data, offs)) >= CUT
                yield part.filter(pa.array(good))

    plain = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # Arrow functions take plain names only
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)])
    return docs.toDF(*plain).mapInArrow(lean(run), schema).toDF(*docs.columns)

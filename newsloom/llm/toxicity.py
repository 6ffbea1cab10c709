"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is a sequence of lower-cased words. A word's input joins two learned embeddings, one of the word and one of its characters
(the mean over its sequences of GRAM bytes at every place of the word, the first and last ones marked), both in hashed tables
that are trained with the network, and what the labelled sample says of the word and of its prefixes (log-odds,
cross-fitted while training so that no document vouches for itself). The network reads every window of WINDOW words,
windows overlapping by half, over the whole text; attention pools a window's states, and the windows' scores together
(mean, share of high ones, largest) give the document's score. Trained in numpy, on a bounded sample; each step takes
windows at random from all windows of the sampled documents.

Bytes over 127 never separate words, so in scripts without spaces a whole run is one word: its characters reach the score by
their mean embedding.

Defined cases: a null or empty text, or one without words, scores 0; without labels of both kinds every text scores
0; repeated rows get the same score (five decimals); extra columns and the columns lang, source and doc_id are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._learn import Adam, logistic, sample, sigmoid
from newsloom.llm._shared import LOWER, batch_of, distinct, documents_of, fold, lean, mix, range_hashes, steps, words

#: Documented bound of the training sample: documents of label 0 and 1 (of any length; ``_learn.spread`` bounds what is read of one).
SAMPLE = (1200, 700)
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
WINDOW, STRIDE, HIDDEN = 64, 32, 8
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
BITS = 19
#: Bytes of text of a step and windows of a pass of the network: what a worker holds at a time.
STEP, PASS = 1 << 18, 1024
STEPS, BATCH = 320, 256
#: Everything but letters and digits separates words; bytes over 127 are parts of letters.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Learned embeddings: bits of the hashed tables, dimensions, bytes of a character sequence.
EMBED_BITS, DIM, GRAM = 15, 4, 4
N_EVIDENCE = 6
N_INPUT = N_EVIDENCE + 2 * DIM


class Words(NamedTuple):
    """Words of some texts: the texts' offsets into them; slots of the word and of its prefixes in the evidence tables; slots of
    the word and of its character sequences in the embedding tables, the latter from ``grams_at[i]`` on."""

    ends: np.ndarray
    word: np.ndarray
    prefix: np.ndarray
    name: np.ndarray
    grams: np.ndarray
    grams_at: np.ndarray


def joined(parts: list[Words]) -> Words:
    cat = lambda k: np.concatenate([getattr(p, k) for p in parts])
    running = lambda sizes: np.r_[0, np.cumsum(np.concatenate(sizes))]
    return Words(running([np.diff(p.ends) for p in parts]), cat("word"), cat("prefix"), cat("name"), cat("grams"), running([np.diff(p.grams_at) for p in parts]))


def lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts in lower case (all letters, not only A-Z)."""
    import pyarrow.compute as pc

    at = batch.schema.get_field_index("text")
    return batch.set_column(at, pa.field("text", pa.large_string()), pc.utf8_lower(batch.column(at).cast(pa.large_string())))


def read(data: np.ndarray, offs: np.ndarray) -> Words:
    data = LOWER[data]
    ws, we, row = words(data, offs, GAP)
    mask = np.uint64((1 << BITS) - 1)
    whole = range_hashes(data, ws, we)
    prefix = np.empty((len(ws), len(PREFIXES)), np.int32)
    for i, k in enumerate(PREFIXES):
        prefix[:, i] = (range_hashes(data, ws, np.minimum(ws + k, we)) * np.uint64(2 * k + 1) >> np.uint64(20) & mask).astype(np.int32)
        prefix[we - ws < k, i] = 0  # slot 0 is never evidence
    word = (whole & mask).astype(np.int32)
    small = np.uint64((1 << EMBED_BITS) - 1)
    size = we - ws
    at = np.r_[0, np.cumsum(size)]
    place = np.arange(at[-1]) + np.repeat(ws - at[:-1], size)
    stop = np.minimum(place + GRAM, np.repeat(we, size))
    grams = range_hashes(data, place, stop)
    grams[at[:-1]] = mix(grams[at[:-1]])  # a word's first sequence; its last ones are shorter than GRAM
    return Words(np.searchsorted(row, np.arange(len(offs))), word, prefix, (whole >> np.uint64(24) & small).astype(np.int32), (grams & small).astype(np.int32), at)


def evidence(slots: np.ndarray, owner: np.ndarray, label: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
    """Log-odds of each slot among texts of label 1 against 0, shrunk; 0 where texts are too few to tell."""
    pairs = distinct(owner.astype(np.int64) << BITS | slots)
    slot, toxic = pairs & (size - 1), label[pairs >> BITS] == 1
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    a, b = np.bincount(slot[toxic], minlength=size), np.bincount(slot[~toxic], minlength=size)
    odds = np.log((a + 0.3) / (n1 + 0.6)) - np.log((b + 0.3) / (n0 + 0.6))
    z = odds / np.sqrt(1 / (a + 0.3) + 1 / (b + 0.3))
    out = np.where((np.abs(z) > 1.3) & (a + b >= 3), odds, 0).clip(-4, 6)
    out[0] = 0
    return out.astype(np.float32)


def evident(w: Words, of_word: np.ndarray, of_prefix: np.ndarray) -> np.ndarray:
    """The words' evidence, (words, N_EVIDENCE)."""
    p = of_prefix[w.prefix]
    e = of_word[w.word]
    most = p.max(1) if len(p) else np.zeros(0, np.float32)
    return np.column_stack([e / 3, most / 3, p.mean(1) if len(p) else most, np.maximum(e, most) > 2.0, np.minimum(e, p.min(1) if len(p) else most) / 3, np.ones(len(e))]).astype(np.float32)


def embedded(w: Words, names: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The words' learned inputs, (words, 2 * DIM)."""
    out = np.empty((len(w.word), 2 * DIM), np.float32)
    if len(out):
        out[:, :DIM] = names[w.name]
        out[:, DIM:] = np.add.reduceat(grams[w.grams], w.grams_at[:-1]) / np.diff(w.grams_at)[:, None]
    return out


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of every window: starts STRIDE apart until the text's end is covered."""
    n = np.diff(ends)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return row, ends[row] + first, np.minimum(WINDOW, n[row] - first)


class BiGru:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @staticmethod
    def fresh(seed: int = 11) -> BiGru:
        rng = np.random.default_rng(seed)
        p = {}
        for d in ("f", "b"):
            p[f"w{d}"] = rng.normal(0, 0.4, (N_INPUT, 3 * HIDDEN)).astype(np.float32)
            p[f"r{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
            p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        p["att"], p["attw"] = rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(np.float32), rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        p["out"], p["bias"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        return BiGru(p)

    def _run(self, x: np.ndarray, here: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, B, H). A step outside the text leaves the state as it is."""
        p, n = self.p, HIDDEN
        r_zr, r_n = p[f"r{d}"][:, : 2 * n], p[f"r{d}"][:, 2 * n :]
        g = x @ p[f"w{d}"] + p[f"c{d}"]
        h, out, saved = np.zeros((x.shape[1], n), np.float32), np.empty((len(x), x.shape[1], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            zr = h @ r_zr
            zr += g[t, :, : 2 * n]
            zr *= 0.5  # the logistic function by tanh
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :n], zr[:, n:]
            hn = h @ r_n
            c = r * hn
            c += g[t, :, 2 * n :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            m = here[t][:, None]
            if keep:
                saved.append((t, h, z, r, hn, c, m))
            h = np.where(m, new, h)
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, here: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        p = self.p
        (f, sf), (b, sb) = self._run(x, here, "f", keep), self._run(x, here, "b", keep)
        h = np.concatenate([f, b], 2)
        a = np.tanh(h @ p["att"])
        e = np.where(here, a @ p["attw"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, h)
        return pooled @ p["out"] + p["bias"][0], (h, a, alpha, pooled, sf, sb)

    def gradients(self, x: np.ndarray, here: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float, np.ndarray]:
        """Gradients of the parameters, the loss, and the gradient of the input."""
        p, n = self.p, HIDDEN
        logit, (h, a, alpha, pooled, sf, sb) = self.forward(x, here, True)
        prob = sigmoid(logit)
        dl = ((prob - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["out"]
        d_alpha = np.einsum("bh,tbh->tb", dp, h)
        de = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        da = de[:, :, None] * p["attw"] * (1 - a * a)
        grads["attw"] = np.einsum("tb,tbh->h", de, a)
        grads["att"] = np.einsum("tbi,tbj->ij", h, da)
        dh_all = alpha[:, :, None] * dp + da @ p["att"].T
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, dh_all[:, :, :n]), ("b", sb, dh_all[:, :, n:])):
            dw, dr, dc = (np.zeros_like(p[f"{k}{d}"]) for k in "wrc")
            carry = np.zeros((x.shape[1], n), np.float32)
            for t, h0, z, r, hn, c, m in reversed(saved):
                dh = carry + part[t]
                live = dh * m
                dz, dcand = live * (h0 - c), live * (1 - z)
                dpre = dcand * (1 - c * c)
                dg = np.concatenate([dz * z * (1 - z), dpre * hn * r * (1 - r), dpre], 1)
                rec = np.concatenate([dg[:, : 2 * n], dpre * r], 1)
                dw += x[t].T @ dg
                dx[t] += dg @ p[f"w{d}"].T
                dr += h0.T @ rec
                dc += dg.sum(0)
                carry = dh * ~m + live * z + rec @ p[f"r{d}"].T
            grads |= {f"w{d}": dw, f"r{d}": dr, f"c{d}": dc}
        return grads, float(-np.mean(np.where(y > 0.5, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))), dx


def lay(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B, inputs) and the mask of real words."""
    t = np.arange(int(size.max()))[:, None]
    here = t < size[None, :]
    return x[np.where(here, first[None, :] + t, first[None, :])], here


class Model(NamedTuple):
    gru: BiGru | None
    of_word: np.ndarray | None
    of_prefix: np.ndarray | None
    names: np.ndarray | None
    grams: np.ndarray | None
    head: np.ndarray | None

    def window_logits(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), PASS):
            out[a : a + PASS] = self.gru.forward(*lay(x, first[a : a + PASS], size[a : a + PASS]))[0]
        return out

    def score(self, w: Words) -> np.ndarray:
        n = len(w.ends) - 1
        out = np.zeros(n)
        row, first, size = windows(w.ends)
        if self.gru is None or not len(row):
            return out
        has, stats = pooled(row, self.window_logits(np.hstack([evident(w, self.of_word, self.of_prefix), embedded(w, self.names, self.grams)]), first, size), n)
        out[has] = sigmoid(np.c_[stats, np.ones(len(stats))] @ self.head).round(5)  # beyond that, sums depend on the batch
        return out


def pooled(row: np.ndarray, logits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with windows, and over their windows: mean logit, largest logit, mean probability, share of likely ones."""
    has = np.flatnonzero(np.bincount(row, minlength=n))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[starts, len(row)])
    logits = logits.clip(-8, 8).astype(np.float64)
    prob = sigmoid(logits)
    mean = lambda v: np.add.reduceat(v, starts) / count
    return has, np.stack([mean(logits) / 4, np.maximum.reduceat(logits, starts) / 4, mean(prob) * 2, mean(prob > 0.5) * 2], 1)


def summed(slots: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """(size, columns): the sum of the rows of each slot."""
    return np.stack([np.bincount(slots, v, size) for v in values.T], 1).astype(np.float32)


def fit(w: Words, y: np.ndarray, parts: int = 4, seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(y)), np.diff(w.ends))
    part = rng.permutation(len(y)) % parts

    def tables(rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return evidence(w.word[rows], owner[rows], label), evidence(w.prefix[rows].ravel(), np.repeat(owner[rows], len(PREFIXES)), label)

    x = np.empty((len(w.word), N_EVIDENCE), np.float32)
    for k in range(parts):  # evidence for a part comes from the others
        others = part[owner] != k
        x[~others] = evident(w._replace(word=w.word[~others], prefix=w.prefix[~others]), *tables(others, np.where(part != k, y, -1)))
    row, first, size = windows(w.ends)
    gru = BiGru.fresh()
    table = {k: rng.normal(0, 0.1, (1 << EMBED_BITS, DIM)).astype(np.float32) for k in ("names", "grams")}
    adam, tuned = Adam(gru.p, 0.01), Adam(table, 0.003, 1e-3)
    order = np.concatenate([rng.permutation(len(row)) for _ in range(-(-STEPS * BATCH // len(row)))])
    per = np.diff(w.grams_at)
    for step in range(STEPS):
        adam.rate, tuned.rate = (r * 0.1 ** (step / STEPS) for r in (0.01, 0.003))
        pick = order[step * BATCH : (step + 1) * BATCH]
        t = np.arange(int(size[pick].max()))[:, None]
        here = t < size[pick][None, :]
        at = np.where(here, first[pick][None, :] + t, first[pick][None, :])
        used, back = np.unique(at, return_inverse=True)  # the batch's words, once each
        spans = per[used]
        of_gram = np.repeat(np.arange(len(used)), spans)
        grams = w.grams[np.repeat(w.grams_at[used] - (np.cumsum(spans) - spans), spans) + np.arange(len(of_gram))]
        some = Words(w.ends, w.word[used], w.prefix[used], w.name[used], grams, np.r_[0, np.cumsum(spans)])
        inside = np.hstack([x[used], embedded(some, table["names"], table["grams"])])
        grads, _, dx = gru.gradients(inside[back.reshape(at.shape)], here, y[row[pick]])
        adam.step(grads)
        d = summed(back.reshape(at.shape)[here], dx[here][:, N_EVIDENCE:], len(used))
        tuned.step({"names": summed(some.name, d[:, :DIM], 1 << EMBED_BITS), "grams": summed(grams, (d[:, DIM:] / spans[:, None])[of_gram], 1 << EMBED_BITS)})
    model = Model(gru, *tables(np.ones(len(owner), bool), y), table["names"], table["grams"], None)
    logits = model.window_logits(np.hstack([x, embedded(w, table["names"], table["grams"])]), first, size)
    has, stats = pooled(row, logits, len(y))
    return model._replace(head=logistic(stats, y[has]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels.toxic of documents outside the held-out fold, within the documented sample."""
    rows = sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE)
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(*[None] * len(Model._fields))
    parts = [read(data, offs) for _, data, offs in steps(lower(pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.large_string())], names=["text"])))]
    w = joined(parts)
    return fit(w, y) if len(w.word) else Model(*[None] * len(Model._fields))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in steps(lower(batch), most=STEP):
                yield batch_of(SCORED, doc_id=part["doc_id"], score=model.score(read(data, offs)))

    return documents_of(docs).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

"""Quality rules: a linear-chain CRF labels the lines of a text; its share of content decides retention.

Base counts come from the whole text. Lines with a word are then labelled content or boilerplate by Viterbi decoding,
and a document is kept if it passes the base rules and at least ``CONTENT_SHARE`` of its word characters are in
content lines. The CRF is trained in numpy by maximum likelihood (forward-backward) on a bounded sample of labelled
documents: lines inherit the document's quality label, then those of bad documents are relabelled by the first model.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; without labels of both
kinds every line is content; repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._learn import labelled, texts_of
from newsloom.llm._shared import batch_of, counts_by_row, documents_of, lean, mix, range_hashes, steps, words

#: Documented bound of the training sample: documents (of any length; ``_learn.spread`` bounds what is read of one).
SAMPLE_DOCS = 800
#: Documents whose crc32(id) modulo 4 is 2 stay out of the sample, as in the quality classifier.
FOLDS, HELD_OUT = 4, 2
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
OTHER_MARKS = np.zeros(256, bool)
OTHER_MARKS[list(b"!=@^~_{}[]\\")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])


class Lines(NamedTuple):
    """Lines with a word, in order: document row, features, word characters; and the base counts of each document."""

    row: np.ndarray
    features: np.ndarray
    chars: np.ndarray
    base: dict[str, np.ndarray]


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Whether the same key stands at an earlier place."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first[back] != np.arange(len(keys))


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def read(data: np.ndarray, offs: np.ndarray) -> Lines:
    n = len(offs) - 1
    ws, we, wrow = words(data, offs)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    wh = range_hashes(data, ws, we)
    # lines: \n is one of the gaps between words, so no word spans two lines
    brk = np.flatnonzero(data == 10)
    ls, lrow = np.r_[offs[:-1], brk + 1], np.r_[np.arange(n), np.searchsorted(offs, brk, "right") - 1]
    by = np.lexsort((ls, lrow))
    ls, lrow = ls[by], lrow[by]
    last = np.r_[lrow[1:] != lrow[:-1], True]
    le = np.where(last, offs[lrow + 1], np.r_[ls[1:] - 1, 0])
    # words of each line
    w0, w1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    has = w1 > w0
    lines = np.flatnonzero(has)
    l_s, l_e, l_row, w0, w1 = ls[lines], le[lines], lrow[lines], w0[lines], w1[lines]
    dup = _earlier(mix(range_hashes(data, l_s, l_e) ^ salt[l_row]))
    # three-word windows found twice or more in the same text
    covered = np.zeros(len(ws), bool)
    if len(ws) >= 3:
        whole = wrow[2:] == wrow[:-2]
        tri = mix(mix(wh[:-2]) + mix(wh[1:-1] * np.uint64(3)) + mix(wh[2:] * np.uint64(5)) ^ salt[wrow[:-2]])[whole]
        _, back, count = np.unique(tri, return_inverse=True, return_counts=True)
        at = np.flatnonzero(whole)[count[back] > 1]
        for k in range(3):
            covered[at + k] = True
    lead = _running((data & 0xC0) != 0x80)
    wchars = lead[we] - lead[ws]
    base = {
        "n_words": counts_by_row(wrow, n),
        "word_chars": np.bincount(wrow, wchars, n).astype(np.int64),
        "n_symbols": np.diff(_running(SYMBOLS[data])[offs]),
        "n_dup_lines": counts_by_row(l_row[dup], n),
        "n_repeat_words": np.bincount(wrow, covered, n).astype(np.int64),
    }
    words_in = (w1 - w0).astype(float)
    cum_chars = _running(wchars)
    chars = (cum_chars[w1] - cum_chars[w0]).astype(float)

    def share(mark: np.ndarray) -> np.ndarray:
        c = _running(mark)
        return (c[l_e] - c[l_s]) / chars

    same = np.zeros(len(ws), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (wrow[1:] == wrow[:-1])
    per_word = lambda mark: (_running(mark)[w1] - _running(mark)[w0]) / words_in
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = share(upper | lower) + 1e-9
    sym, pipe = share(SYMBOLS[data]), share(data == ord("|"))
    features = np.stack(
        [
            np.ones(len(lines)),
            np.minimum(sym * 5, 3),
            sym > 0.08,
            np.minimum(pipe * 10, 3),
            np.minimum(share(OTHER_MARKS[data]) * 5, 3),
            share(OTHER_MARKS[data]) > 0.08,
            share(upper) / letters,
            share(upper) / letters > 0.5,
            np.minimum(share((data >= 48) & (data <= 57)) * 3, 3),
            per_word(same),
            per_word(same) > 0.2,
            per_word(covered),
            dup,
            np.log1p(words_in) / 4,
            words_in < 5,
            np.minimum(chars / words_in / 10, 3),
            np.isin(data[np.maximum(we[np.maximum(w1 - 1, 0)] - 1, 0)], list(b".!?")) if len(lines) else np.zeros(0),
        ],
        1,
    ).astype(np.float64)
    return Lines(l_row, features, chars, base)


N_FEATURES = 17


class Crf(NamedTuple):
    """Two labels, 1 content. Emission weights of label 1 against label 0, and transition scores [from, to]."""

    w: np.ndarray
    trans: np.ndarray

    def viterbi(self, row: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Labels of the lines; ``row`` is ascending. All sequences step together; the ended ones drop out."""
        out = np.zeros(len(row), np.int64)
        if not len(row):
            return out
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[start, len(row)])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        emit = features @ self.w
        back = np.zeros((len(row), 2), np.int8)
        best = np.stack([np.zeros(len(start)), emit[start]], 1)
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
            come = best[:live, :, None] + self.trans
            pick = come.argmax(1)
            back[start[:live] + t] = pick
            best[:live] = np.take_along_axis(come, pick[:, None], 1)[:, 0]
            best[:live, 1] += emit[start[:live] + t]
        state = best.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            at = start[:live] + t
            out[at] = state[:live]
            if t:
                state[:live] = back[at, state[:live]]
        return out


def fit_crf(sequences: list[np.ndarray], labels: list[np.ndarray], weight: list[float], rounds: int = 120) -> Crf:
    """Gradient ascent (Adam) on the conditional log-likelihood, with forward-backward over all sequences at once.

    Lines lie one after another, without padding; at step t those sequences move on that are longer than t.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    size = np.array([len(sequences[i]) for i in order])
    x, y = np.concatenate([sequences[i] for i in order]), np.concatenate([labels[i] for i in order]).astype(np.int64)
    ends = np.cumsum(size)
    start, total = ends - size, len(x)
    seq_w = np.array([weight[i] for i in order]) / size  # a long text counts as much as a short one
    line_w = np.repeat(seq_w, size)
    steps_ = [start[: int((size > t).sum())] + t for t in range(int(size[0]))]
    inner = np.ones(total, bool)  # lines with a next one
    inner[ends - 1] = False
    inner = np.flatnonzero(inner)
    want = np.zeros((2, 2))
    np.add.at(want, (y[inner], y[inner + 1]), line_w[inner])
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, rounds + 1):
        emit = np.stack([np.zeros(total), x @ w], 1)
        alpha, beta = emit.copy(), np.zeros((total, 2))
        for at in steps_[1:]:
            alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + trans, 1) + emit[at]
        for at in steps_[:0:-1]:
            beta[at - 1] = np.logaddexp.reduce(trans + (emit[at] + beta[at])[:, None, :], 2)
        z = np.repeat(np.logaddexp.reduce(alpha[ends - 1], 1), size)
        p1 = np.exp(alpha[:, 1] + beta[:, 1] - z)
        pair = np.exp(alpha[inner][:, :, None] + trans + (emit[inner + 1] + beta[inner + 1])[:, None, :] - z[inner][:, None, None])
        g_t = want - (pair * line_w[inner][:, None, None]).sum(0)
        g = np.r_[((y - p1) * line_w) @ x, g_t.ravel()] / seq_w.sum() - 1e-3 * np.r_[w, trans.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return Crf(w, trans)


ALL_CONTENT = Crf(np.r_[10.0, np.zeros(N_FEATURES - 1)], np.zeros((2, 2)))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS) -> Crf:
    """Fits on at most ``most_docs`` labelled documents, the first by hash of the id, whatever their length."""
    first = labelled(docs, labels, "quality", FOLDS, HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = texts_of(docs, first).rename(columns={"label": "quality"})
    if rows["quality"].nunique() < 2:
        return ALL_CONTENT
    batch = pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.large_string())], names=["text"])
    xs, quality, at = [], [], 0
    for part, data, offs in steps(batch):
        lines = read(data, offs)
        for k in range(part.num_rows):
            f = lines.features[lines.row == k]
            if len(f):
                xs.append(f)
                quality.append(int(rows["quality"].iloc[at + k]))
        at += part.num_rows
    share = np.mean(quality)
    weight = [0.5 / share if q else 0.5 / (1 - share) for q in quality]
    first = fit_crf(xs, [np.full(len(x), q) for x, q in zip(xs, quality, strict=True)], weight)
    again = [np.ones(len(x), np.int64) if q else first.viterbi(np.zeros(len(x), np.int64), x) for x, q in zip(xs, quality, strict=True)]
    return fit_crf(xs, again, weight)


def judge(lines: Lines, crf: Crf) -> dict[str, np.ndarray]:
    n = len(lines.base["n_words"])
    label = crf.viterbi(lines.row, lines.features)
    content, every = np.bincount(lines.row, lines.chars * label, n), np.bincount(lines.row, lines.chars, n)
    share = np.divide(content, every, out=np.zeros(n), where=every > 0)
    failed = (lines.base["n_words"] < MIN_WORDS) | (100 * lines.base["n_repeat_words"] > MAX_REPEAT_PERCENT * lines.base["n_words"])
    return lines.base | {"base_failed": failed, "content_share": share, "kept": ~failed & (share >= CONTENT_SHARE)}


def apply_rules(docs: DataFrame, crf: Crf) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in steps(batch):
                yield batch_of(ARROW, doc_id=part["doc_id"], **judge(read(data, offs), crf))

    return documents_of(docs).mapInArrow(lean(run), SCHEMA)

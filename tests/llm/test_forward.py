"""Scores and verdicts of the trained operators against plain loops over their parameters."""

from itertools import product
from math import exp, sqrt, tanh

import numpy as np
import pytest

from newsloom.llm import quality_mil, quality_rules, toxicity

SF = "/root/testdata/sf0.001"


def sigmoid(x):
    return 1 / (1 + exp(-max(-60.0, min(60.0, x))))


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    return docs, labels, texts


def laid(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def gru(p, d, xs):
    """States of one direction, step by step."""
    n, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), {}
    for t in range(len(xs)) if d == "f" else range(len(xs) - 1, -1, -1):
        g = xs[t] @ p[f"w{d}"] + p[f"c{d}"]
        r = h @ p[f"r{d}"]
        z = np.array([sigmoid(g[i] + r[i]) for i in range(n)])
        reset = np.array([sigmoid(g[n + i] + r[n + i]) for i in range(n)])
        new = np.array([tanh(g[2 * n + i] + reset[i] * r[2 * n + i]) for i in range(n)])
        h = out[t] = (1 - z) * new + z * h
    return [out[t] for t in range(len(xs))]


def toxic_score(model, text):
    w = toxicity.read(*laid(text.lower()))
    x = np.hstack([toxicity.evident(w, model.of_word, model.of_prefix), toxicity.embedded(w, model.names, model.grams)]).astype(float)
    if not len(x):
        return 0.0
    p, logits, at = {k: v.astype(float) for k, v in model.gru.p.items()}, [], 0
    while True:
        xs = x[at : at + toxicity.WINDOW]
        states = [np.r_[a, b] for a, b in zip(gru(p, "f", xs), gru(p, "b", xs), strict=True)]
        energy = [exp(float(np.tanh(s @ p["att"]) @ p["attw"])) for s in states]
        pooled = sum(e * s for e, s in zip(energy, states, strict=True)) / sum(energy)
        logits.append(max(-8.0, min(8.0, float(pooled @ p["out"] + p["bias"][0]))))
        if at + toxicity.WINDOW >= len(x):
            break
        at += toxicity.STRIDE
    probs = [sigmoid(v) for v in logits]
    stats = [sum(logits) / len(logits) / 4, max(logits) / 4, sum(probs) / len(probs) * 2, sum(q > 0.5 for q in probs) / len(probs) * 2]
    return sigmoid(float(np.dot(stats, model.head[:-1]) + model.head[-1]))


def test_toxicity(spark, tables):
    docs, labels, texts = tables
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    some = sorted(texts, key=lambda i: len(texts[i]))[::9]
    assert len(some) > 15 and max(len(texts[i].split()) for i in some) > 3 * toxicity.WINDOW
    for i in some:
        assert got[i] == pytest.approx(toxic_score(model, texts[i]), abs=2e-4), i
    assert toxic_score(model, "") == 0 and len({round(got[i], 3) for i in some}) > 5


def quality_score(model, text):
    x, _ = quality_mil.passages(*laid(text))
    p, hidden, energy = model.p, [], []
    for row in x.astype(float):
        v = (row - model.mean) / model.scale
        h = np.array([tanh(a) for a in v @ p["w"] + p["b"]])
        gate = [tanh(a) * sigmoid(b) for a, b in zip(h @ p["v"], h @ p["u"], strict=True)]
        hidden.append(h)
        energy.append(float(np.dot(gate, p["a"])))
    weight = [exp(e - max(energy)) for e in energy]
    bag = sum(a * h for a, h in zip(weight, hidden, strict=True)) / sum(weight)
    return sigmoid(float(bag @ p["c"] + p["d"][0]))


def test_quality(spark, tables):
    docs, labels, texts = tables
    model = quality_mil.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_mil.score(docs, model).collect()}
    for i in sorted(texts)[::5]:
        assert got[i] == pytest.approx(quality_score(model, texts[i]), abs=1e-5), i
    kept = {r.doc_id for r in quality_mil.keep(docs, model).collect()}
    assert kept == {i for i in texts if got[i] >= quality_mil.CUT}


def verdict(crf, text):
    """Content share by trying every labelling of the lines, and the verdict."""
    lines = quality_rules.read(*laid(text))
    n, emit = len(lines.row), lines.features @ crf.w
    best = max(product((0, 1), repeat=n), key=lambda y: sum(emit[t] * y[t] for t in range(n)) + sum(crf.trans[y[t], y[t + 1]] for t in range(n - 1)))
    words = text.split()
    chars = [sum(len(w) for w in line.split()) for line in text.split("\n") if line.split()]
    assert chars == lines.chars.tolist()
    share = sum(c for c, y in zip(chars, best, strict=True) if y) / sum(chars) if chars else 0.0
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {k for i, v in enumerate(windows) if windows.count(v) > 1 for k in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return failed, share, not failed and share >= quality_rules.CONTENT_SHARE


def test_verdicts(spark, tables):
    docs, labels, texts = tables
    crf = quality_rules.train(docs, labels)
    got = {r.doc_id: (r.base_failed, r.content_share, r.kept) for r in quality_rules.apply_rules(docs, crf).collect()}
    few = [i for i, t in texts.items() if sum(bool(x.split()) for x in t.split("\n")) <= 10 and len(t) < 6000]
    assert len(few) > 50 and sqrt(len(few)) > 7
    for i in few:
        failed, share, kept = verdict(crf, texts[i])
        assert got[i][0] == failed and got[i][1] == pytest.approx(share) and got[i][2] == kept, i
    assert {k for *_, k in got.values()} == {True, False}


def test_many_lines(spark):
    """A text of 50 000 lines is decoded in one pass and whole."""
    rows = [(1, "\n".join(f"A line of plain words number {i} is here." for i in range(50_000))), (2, "one line")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), quality_rules.ALL_CONTENT).collect()}
    assert got[1].n_words == 450_000 and got[1].content_share == 1.0 and not got[2].kept

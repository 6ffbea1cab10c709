"""Operators that read one text at a time, against plain Python."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from newsloom.llm import bpe, chat, html_wrapper, quality_mil, quality_rules, toxicity
from newsloom.llm._shared import steps, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def labels_of(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_words_never_span_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "cd e", None, "", " f"])], names=["text"])
    (_, data, offs), = steps(batch)
    s, e, row = words(data, offs)
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"e", b"f"]
    assert row.tolist() == [0, 1, 1, 4]


@pytest.mark.parametrize("name", ["odd", "sf0.001"])
def test_bpe_equals_tiktoken(spark, odd, name):
    docs = odd if name == "odd" else docs_of(spark)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bpe.vocabulary(PATH))}, special_tokens={})
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = collections.Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_bpe_of_one_long_word_and_of_nothing(spark, no_docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bpe.vocabulary(PATH))}, special_tokens={})
    text = "abcdefgh" * 60 + "<|endoftext|>"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode(df, PATH, public_tokenizers.PATTERN).first().ids == enc.encode_ordinary(text)
    assert bpe.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <b> \\ c"), (1, 1, "assistant", "</turn>\n<turn:user>x\\<"), (1, 1, "assistant", "</turn>\n<turn:user>x\\<"), (2, None, None, None), (None, 3, "assistant", "ünï 🐈"), (3, 0, "we>ird\\", "\\\\>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text as formatted", "1 as n_turns")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(out) == {1, 2, 3, None}
    for conv, r in out.items():
        want = sorted(((t if t is not None else -1, x or "", y or "") for c, t, x, y in rows if c == conv))
        assert [(a.decode(), b.decode()) for a, b in chat.parse(r.formatted.encode())] == [(x, y) for _, x, y in want]
        assert [chat.unescape(r.formatted[s.start : s.end].encode()).decode() for s in r.loss_spans] == [y for _, x, y in want if x == "assistant"]
    assert chat.format_conversations(df.where("false")).count() == 0


def test_a_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 2 as conv_id", "id as turn", "if(id % 3 = 0, 'assistant', 'user') as role", "concat('t', id) as text")
        for r in chat.digest(chat.format_conversations(df)).collect():
            assert r.n_turns == 50
        for r in chat.format_conversations(df).collect():
            assert [b.decode() for _, b in chat.parse(r.formatted.encode())] == [f"t{i}" for i in range(r.conv_id, 100, 2)]
            assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [f"t{i}" for i in range(r.conv_id, 100, 2) if i % 3 == 0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def counts(text):
    w = WORD.findall(text or "")
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("name", ["odd", "sf0.001"])
def test_quality_rules_base_counts(spark, odd, name):
    docs = odd if name == "odd" else docs_of(spark)
    crf = quality_rules.train(docs_of(spark), labels_of(spark))
    got = quality_rules.apply_rules(docs, crf).collect()
    want = collections.Counter((r.doc_id, *counts(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    crf = quality_rules.Crf(rng.normal(size=quality_rules.N_FEATURES), rng.normal(size=(2, 2)))
    row = np.array([0, 0, 0, 0, 2, 5, 5])
    x = rng.normal(size=(7, quality_rules.N_FEATURES))
    got = crf.viterbi(row, x)
    for r in set(row):
        e = x[row == r] @ crf.w
        n = len(e)
        paths = [[p >> i & 1 for i in range(n)] for p in range(1 << n)]
        best = max(paths, key=lambda p: sum(e[i] * p[i] for i in range(n)) + sum(crf.trans[p[i], p[i + 1]] for i in range(n - 1)))
        assert got[row == r].tolist() == best


def test_crf_gradient_raises_likelihood_and_separates():
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=(5, quality_rules.N_FEATURES)) for _ in range(60)]
    ys = [(x[:, 3] > 0).astype(int) for x in xs]
    crf = quality_rules.fit_crf(xs, ys, [1.0] * 60)
    hits = np.mean([np.mean(crf.viterbi(np.zeros(5, int), x) == y) for x, y in zip(xs, ys, strict=True)])
    assert hits > 0.95


def held_out(spark, module, label, sf):
    docs, labels = docs_of(spark, sf), labels_of(spark, sf)
    known = {r.doc_id: r[label] for r in labels.collect()}
    got = module.classify(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT) for r in got)
    return [(known[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in known]


def test_quality_held_out_accuracy(spark):
    pairs = held_out(spark, quality_mil, "quality", "sf0.01")
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_toxicity_held_out_accuracy(spark):
    pairs = held_out(spark, toxicity, "toxic", "sf0.01")
    assert np.mean([a == b for a, b in pairs]) > 0.92
    assert np.mean([b for a, b in pairs if a]) > 0.75


@pytest.mark.parametrize("module", [quality_mil, toxicity])
def test_classifiers_with_odd_rows_and_without_labels(spark, odd, no_docs, module):
    labels = labels_of(spark).where("false")
    got = module.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert module.classify(no_docs, labels_of(spark)).count() == 0
    model = module.train(docs_of(spark), labels_of(spark))
    scores = collections.defaultdict(set)
    for r in module.score(odd, model).collect():
        scores[r.doc_id].add(r.score)
    assert max(scores[6]) - min(scores[6]) < 2e-5 and abs(max(scores[1]) - max(scores[2])) < 2e-5


def test_recurrent_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    gru = toxicity.BiGru.fresh()
    gru.p = {k: v.astype(np.float64) for k, v in gru.p.items()}
    x, here, y = rng.normal(size=(5, 3, toxicity.N_INPUT)), np.array([[1, 1, 1]] * 3 + [[1, 0, 1], [0, 0, 1]], bool), np.array([1.0, 0, 1])
    grads, _, dx = gru.gradients(x, here, y)
    near = [gru.gradients(x + sign * 1e-3 * (np.arange(x.size).reshape(x.shape) == 4), here, y)[1] for sign in (1, -1)]
    assert abs((near[0] - near[1]) / 2e-3 - dx.ravel()[4]) < 5e-4
    for k in ("wf", "rb", "att", "cf", "out"):
        at = (0,) * gru.p[k].ndim
        for sign, store in ((1, "up"), (-1, "down")):
            gru.p[k][at] += sign * 1e-3
            loss = gru.gradients(x, here, y)[1]
            gru.p[k][at] -= sign * 1e-3
            up = loss if store == "up" else up
        assert abs((up - loss) / 2e-3 - grads[k][at]) < 5e-4


def test_mil_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    x, ends, y = rng.normal(size=(6, quality_mil.N_FEATURES)), np.array([0, 2, 3, 6]), np.array([1.0, 0, 1])
    model = quality_mil.fit(x, ends, y, epochs=1)
    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, ends)[0]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    grads = model.gradients(x, ends, y, np.ones(3))
    for k in ("w", "v", "u", "a", "c", "b"):
        at = (0,) * model.p[k].ndim
        model.p[k][at] += 1e-5
        up = loss()
        model.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[k][at]) < 1e-5
        model.p[k][at] += 1e-5


def test_pages(spark):
    page = '<html><body class="has-sidebar"><header>Site</header><nav>m</nav><div id="cookie-notice">We use</div><article><h1>T &amp; x</h1><p>One<b>two<br><p>Three &#233;&nbsp;b<ul><li>a<li>b</ul><form><p>mail</p></form><script>var t="</p>";</script><div class="comments"><p>c1</p></div></article><aside>side</aside><footer>f</footer>'
    want = "T & x\n\nOnetwo\n\nThree é b\n\na\n\nb"
    rows = [(i, f"http://h.example/{i}", page.replace("One", f"One{i}")) for i in range(5)] + [(9, "http://solo.example/", page), (10, None, None), (11, "x", ""), (12, "y", "plain <b>text</b>"), (12, "y", "plain <b>text</b>"), (13, "z", "<p>cut off &am")]
    out = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "url as host")).collect()
    got = collections.Counter((r.page_id, r.text) for r in out)
    expect = collections.Counter([(i, want.replace("One", f"One{i}")) for i in range(5)] + [(9, want), (10, ""), (11, ""), (12, "plain text"), (12, "plain text"), (13, "cut off &am")])
    assert got == expect and all(r.n_chars == len(r.text) for r in out)
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_has_optional_and_repeated_groups():
    a = ["<ul>", "<li>", "#", "</li>", "<li>", "#", "</li>", "</ul>", "<p>", "#", "</p>"]
    b = ["<ul>", "<li>", "#", "</li>", "</ul>", "<hr>", "<p>", "#", "</p>"]
    w = html_wrapper.infer([a, b])
    assert w == ["<ul>", ("+", ("<li>", "#", "</li>")), "</ul>", ("?", ("<hr>",)), "<p>", "#", "</p>"]
    slots = html_wrapper.Matcher(w).slots
    assert slots(a)[0] == slots(a)[1] != slots(a)[2] and slots(b) == [slots(a)[0], slots(a)[2]]
    assert slots([*a, "<x>"]) is None and slots(a[:-1]) is None


LABELLED = [
    ('<div class="layout with-sidebar"><article><p>Body one.</p></article><div class="sidebar">side</div></div>', "Body one."),
    ('<div class="sidebar-layout"><div class="content"><p>Main text of the page, long enough.</p></div><div class="promo">buy</div></div>', "Main text of the page, long enough."),
    ('<p class="a"">Hello', "Hello"),
    ('<p title=\'it"s\' id=x>Fine &lt;b&gt;</p>', "Fine <b>"),
    ("<article><header><h1>Title</h1></header><p>Body text.</p><footer>by us</footer></article><header>Site</header>", "Title\n\nBody text."),
    ("<body><header>Site</header><button>x<p>a < b and c > d</p>", "x\n\na < b and c > d"),
    ('<article><p>One</p><div class="ad">buy</div><p class="notice">n</p><section class="comments"><p>c</p></section><p>Two</p></article>', "One\n\nTwo"),
    ('<main><p>text <a href="x>y">link</a></p></main>', "text link"),
]


@pytest.mark.parametrize("page,want", LABELLED)
def test_labelled_pages(page, want):
    assert html_wrapper.main_text(page) == want


def test_broken_tags_take_linear_time():
    import time

    began = time.time()
    html_wrapper.main_text("<a " * 400_000 + '"')
    html_wrapper.main_text('<a x="' * 100_000)
    html_wrapper.main_text("<button>" * 100_000 + "<p>x")
    assert time.time() - began < 20


def test_the_wrapper_decides(spark):
    """A notice in an element of its own is the same on all pages of a host: it goes, and stays without the wrapper."""
    rows = [(i, f"http://h.example/{i}", f"<body><div><div><p>Article {i} has this text.</p><p>A passage that all share.</p><div>Sign up to our list.</div></div></div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    assert got == {i: f"Article {i} has this text.\n\nA passage that all share." for i in range(6)}
    assert "Sign up" in html_wrapper.main_text(rows[0][2])
    alone = {r.text for r in html_wrapper.extract(df.where("page_id = 2")).collect()}
    assert alone == {html_wrapper.main_text(rows[2][2])}


def test_given_pages_match_their_wrappers(spark):
    """All articles of the smallest tables, by a plain reading of their only article element."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)

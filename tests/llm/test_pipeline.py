"""Each stage of the pipeline against plain Python on the stage's own input."""

import public_tokenizers
import tiktoken
from test_tables import brute_components
from test_texts import PATH

import corpus_pipeline
from newsloom.llm import bpe, quality_mil
from newsloom.llm._shared import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    good = stored(stage["quality classifier"](spark, docs, SF))
    model = quality_mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality_mil.score(docs, model).collect() if r.score >= 0.7}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want and len(want) < docs.count()

    lines = stored(stage["line dedup"](spark, good, SF))
    holders = {}
    for r in good.collect():
        for x in r.text.split("\n"):
            holders.setdefault(x.strip(" \t\n\x0b\x0c\r").lower(), set()).add(r.doc_id)
    texts = {r.doc_id: r.text for r in lines.collect()}
    for r in good.collect():
        kept = [x for x in r.text.split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r").lower()) < 10 or min(holders[k]) == r.doc_id]
        assert texts[r.doc_id] == "\n".join(kept)
    assert lines.columns == columns and all(r.n_chars == len(r.text) for r in lines.collect())

    single = stored(stage["MinHash near-dedup"](spark, lines, SF))
    comps = brute_components([(r.doc_id, r.text) for r in lines.collect()])
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i, (_, c) in comps.items() if c == i}

    mixed = stored(stage["mixing sources to target weights"](spark, single, SF))
    assert mixed.columns == columns
    per = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert per <= 2 and mixed.select("doc_id").subtract(single.select("doc_id")).isEmpty()

    out = stage["byte-level BPE"](spark, mixed, SF).collect()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bpe.vocabulary(PATH))}, special_tokens={})
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == mixed.count() and all(list(r.ids) == enc.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_run_gives_the_same_number_each_time(spark):
    a, b = (sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()) for _ in range(2))
    assert a == b and a


def test_stages_with_odd_rows(spark, odd, no_docs):
    stage = dict(corpus_pipeline.STAGES)
    for f in stage.values():
        assert f(spark, no_docs, SF).count() == 0
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    wide = odd.withColumnsRenamed({"lang": "a.b`c", "size": "drop"})
    for name in ("line dedup", "MinHash near-dedup"):
        got = stage[name](spark, wide, SF)
        assert got.columns == wide.columns
        left = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
        # 2 is a copy of 1; lines go, documents stay
        assert left == (ids if name == "line dedup" else [i for i in ids if i != (False, 2)])
    lines = {r.doc_id: r.text for r in stage["line dedup"](spark, odd, SF).collect()}
    assert lines[2] == "" and lines[1].startswith("Alpha") and lines[3] == lines[4] == "" and lines[9] == "x" * 200000
    tokens = stage["byte-level BPE"](spark, odd, SF).collect()
    assert len(tokens) == len(ids) and all((r.n_tokens == 0) == (r.doc_id in (3, 4)) for r in tokens)


def test_near_dedup_stage_links_from_80_per_cent(spark):
    """Texts of 100 own words have 96 shingles; two changed words leave 86 of 106 (0.81), three leave 81 of 111 (0.73)."""
    rows = []
    for i in range(300):
        words = [f"w{i}x{k}" for k in range(100)]
        rows += [(3 * i, " ".join(words))]
        for j, at in ((1, (30, 60)), (2, (20, 50, 80))):
            rows.append((3 * i + j, " ".join("new" + w if k in at else w for k, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    single = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == {i for i, _ in rows if i % 3 != 1}

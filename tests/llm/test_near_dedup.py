"""Near-dedup against its SQL, repeated ids with different texts, buckets of documents that aren't alike; training on very long texts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tables import brute_components, near_copies

from newsloom.llm import _learn, minhash, quality_mil, quality_rules, toxicity
from newsloom.llm._shared import Stored
from newsloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_op4_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLE["op4_minhash"]).fetchall()
    got = QUERIES["op4_minhash"](spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 5000, n)]


def test_one_id_with_two_texts(spark):
    """A row has the verdict of its own text, whatever the order of the rows."""
    rng = np.random.default_rng(0)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, " ".join(words(rng, 80))), (1, " ".join(a))]
    want = sorted([(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)])
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == want
    swapped = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"]))]
    got = minhash.near_duplicates(spark.createDataFrame(swapped, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (3, 3, True), (5, 2, False), (5, 3, False)]


def test_parts_of_buckets(spark, monkeypatch):
    """Small parts and blocks give what brute force gives."""
    monkeypatch.setattr(minhash, "MEET", 25)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 32)
    rows = near_copies(spark)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_unlike_documents_of_one_bucket_cost_linear_rows(spark):
    """Classes that share a bucket by chance: one or two short rows each, no candidate, no set."""
    rng = np.random.default_rng(1)

    def made(n):
        parts = rng.integers(0, 1 << 16, (n, 144)).astype(np.uint16)
        members = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "cid long, parts binary")
        open_ = spark.createDataFrame([(7, i, i, 300) for i in range(n)], "key long, cid long, label long, n long")
        return Stored(open_).df, Stored(members).df

    def counted(n):
        seen = spark.sparkContext.accumulator(0)
        plain = minhash._meet

        def counting(batches, agree):
            for b in batches:
                seen.add(b.num_rows)
                yield from plain(iter([b]), agree)

        minhash._meet = counting
        try:
            assert minhash.candidates(*made(n), 85).count() == 0
        finally:
            minhash._meet = plain
        return seen.value

    assert [counted(n) / n for n in (500, 2000)] == pytest.approx([2, 2], abs=0.01)


def test_candidates_find_what_agrees(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, 144).astype(np.uint16)
    parts = [np.where(rng.random(144) < share, base, rng.integers(0, 1 << 16, 144)).astype(np.uint16) for share in (1, 0.95, 0.9, 0.3, 0.2)]
    members = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "cid long, parts binary")
    open_ = spark.createDataFrame([(k, i, 10 + i, n) for k in (1, 2) for i, n in enumerate((300, 310, 600, 300, 300))], "key long, cid long, label long, n long")
    assert [tuple(r) for r in minhash.candidates(open_, members, 85).collect()] == [(10, 11)]


def test_a_very_long_labelled_text_trains(spark):
    """3 M code points: pieces of the whole text come to the driver, not the text, and not nothing."""
    body = "".join(f"word{i} of a sentence. " for i in range(140_000))
    rows = [(i, f"Plain text number {i} with a few good words, and a stop.", 1, 0) for i in range(40)] + [(100 + i, f"### BUY $$$ {i} ||| now!!! <<<", 0, 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, body), (501, None), (502, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(500, 1, 1), (501, 1, 1), (502, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(body) > 3_000_000
    got = _learn.sample(docs, labels, "quality", 4, 9, (700, 1000)).set_index("doc_id")
    assert set(got.index) == {r[0] for r in rows} | {500}
    long = got.loc[500].text.split("\n")
    assert len(long) == _learn.PIECES and {len(x) for x in long} == {_learn.PIECE} and long[0] == body[: _learn.PIECE] and long[-1] == body[-_learn.PIECE :]
    assert sorted(body.find(x) for x in long) == [body.find(x) for x in long]
    assert got.loc[3].text == rows[3][1]
    for model in (quality_mil.score(docs, quality_mil.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels))):
        assert model.where(F.col("score").between(0, 1)).count() == docs.count()
    assert quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).count() == docs.count()


def test_smallest_class_of_all_its_buckets_that_is_no_centre(spark):
    """Of 96 shingles, one changed word leaves 91 of 101 (0.90, linked), four leave 76 of 116 (0.66). In many of the triples the first copy is the smallest class of its buckets, and the text has the second as its centre."""
    rows = []
    for i in range(200):
        words = [f"w{i}x{k}" for k in range(100)]
        for j, at in enumerate(((), (50,), (20, 35, 65, 80))):
            rows.append((3 * i + j, " ".join("new" + w if k in at else w for k, w in enumerate(words))))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - (i % 3 == 1) for i, _ in rows}

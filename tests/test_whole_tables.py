"""Queries over whole tables and whole texts: what lies behind a first part of either must count."""

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILLER = "zzz " * 150


@pytest.fixture
def made(spark, tmp_path):
    """Writes a table and returns its folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_pairs_of_all_documents_and_whole_texts(spark, made):
    made("documents", [(1, "alpha beta gamma delta", "en", "a"), (401, "alpha beta gamma other", "en", "a"), (2, FILLER + "alpha beta gamma delta", "en", "a"), (9000, FILLER + "alpha", "en", "a")], "doc_id long, text string, lang string, source string")
    sf = made("benchmark", [(7, "Alpha beta gamma delta."), (8, "nothing here is shared")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared) for r in QUERIES["t11_t12_near_duplicates"](spark, sf).collect()}
    assert got == {(1, 7, 4), (401, 7, 3), (2, 7, 4), (9000, 7, 1)}


def test_round_robin_of_all_events(spark):
    rows = duckdb.sql(f"select event_id, user_id from '{SF}/events.parquet' order by event_id").fetchall()
    turn, first, keys = {}, {}, []
    for event, user in rows:
        turn[user] = turn.get(user, 0) + 1
        keys.append((turn[user], first.setdefault(user, event), event))
    want = {k[2]: i for i, k in enumerate(sorted(keys), 1)}
    assert {r.event_id: r.turn_order for r in QUERIES["o4_round_robin"](spark, SF).collect()} == want and len(want) == 1000


def test_run_log_of_all_orders(spark):
    want = duckdb.sql(f"select case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'failed' end, count(*), sum(trunc(o_totalprice)::bigint)::bigint from '{SF}/orders.parquet' group by 1").fetchall()
    assert {tuple(r) for r in QUERIES["k3_run_log"](spark, SF).select("status", "runs", "processed").collect()} == set(want)
    assert QUERIES["o15_latest_run"](spark, SF).first()["id"] == duckdb.sql(f"select max(o_orderkey) from '{SF}/orders.parquet'").fetchall()[0][0]


def test_decoded_pages_are_all_pages(spark, made):
    sf = made("pages", [(i, f"<p>page {i} é</p>") for i in range(10)], "page_id long, html string")
    assert {(r.page_id, len(r.html)) for r in QUERIES["t24_decoded"](spark, sf).collect()} == {(i, 15) for i in range(10)}


def test_text_operators_read_whole_texts(spark, made):
    long = "word " * 60
    texts = {2: long + "at 10:45 reuter", 5: long + "漢", 7: long + "reuter", 11: long + 'font-family: x', 12: long + "read more here.", 3: long + "10:45 no"}
    sf = made("documents", [(i, t, "en", "a") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    got = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, sf).collect()}
    assert got("t7_cjk_count") == {i: 6 + (i == 5) for i in texts}
    assert got("t9_code_noise") == {i: i in (5, 11) for i in texts}
    assert got("t14_datetime_like") == {i: i in (2, 3, 5, 12) for i in texts}
    assert got("t22_sentence_ending") == {i: i == 12 for i in texts}
    assert got("f15_reuters_text") == {i: t if i == 12 or i == 2 else t.removesuffix(" reuter") for i, t in texts.items()}
    assert got("t16_prefixes") == texts
    assert {i: len(t) for i, t in got("t17_source_cleanup").items()} == {i: len(t) + len(" listen to this article") * (i % 2) - len("read more .") * (i == 12) for i, t in texts.items()}


def test_cached_summaries_equal_those_made_for_each_document(spark):
    from newsloom.functions import article as ar
    from newsloom.plans import articles

    got = {r.doc_id: r.summary for r in articles.QUERIES["g5_cached_summaries"](spark, SF).collect()}
    alone = articles._docs(spark, SF).select("doc_id", ar.summarize(F.col("text"), F.lit("")).alias("summary")).collect()
    assert got == {r.doc_id: r.summary for r in alone} and len(got) == len(alone)


def test_texts_not_lengths(spark):
    from newsloom.plans import articles

    docs = {r.doc_id: r for r in articles._docs(spark, SF).collect()}
    for r in articles.QUERIES["t17_source_cleanup"](spark, SF).collect():
        assert "read more" not in r.text.lower() and docs[r.doc_id].text.strip(" .,-|") in r.text
    pages = {r.page_id: " ".join(r.html.split()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.html for r in articles.QUERIES["t24_decoded"](spark, SF).collect()}
    import html

    assert set(got) == set(pages) and all(" ".join(html.unescape(pages[i]).split()) == got[i] for i in got if "&" not in html.unescape(pages[i]))

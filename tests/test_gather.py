"""Gathering from feed bytes to article texts: every fallback by literal cases, the stored-feed source, redirects and broken feeds."""

import base64

import pytest
from pyspark.sql import functions as F

from newsloom.functions import links
from newsloom.plans import gather
from newsloom.sources import feeds
from newsloom.sources.stored_feeds import StoredFeeds

SF = "/root/testdata/sf0.001"
SOURCE = "source_key string, name string, language string, topic string, country string, region string, site_domain string, rss_urls array<string>"
RESPONSE = "url string, status int, content_type string, body binary"
LONG = "<p>" + "The council met on Tuesday and agreed on a plan for the new bridge across the river. " * 6 + "</p>"


def rss(*items):
    return ("<rss><channel><title>c</title>" + "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate></item>" for t, u, d in items) + "</channel></rss>").encode()


def entry(n, host="a"):
    return (f"T{n}", f"https://{host}/{n}", f"Mon, 0{n} Jan 2024 10:00:00 +0000")


def web(spark, pages):
    return spark.createDataFrame([(u, s, k, bytearray(b)) for u, s, k, b in pages], RESPONSE)


def sources(spark, *urls, key="a", language="en"):
    return spark.createDataFrame([(key, "Name", language, "general", "US", "global", "a.org", list(urls))], SOURCE)


@pytest.mark.parametrize(
    ("first", "rank"),
    [((200, rss(entry(9, "x"))), 0), ((404, rss(entry(9, "x"))), 1), ((200, b""), 1), ((200, b"<rss><channel/></rss>"), 1), ((500, b"<html>"), 1), ((200, b"no feed at all"), 1)],
)
def test_chain_of_feeds(spark, first, rank):
    s = sources(spark, "https://a/1", "https://a/2")
    pages = [("https://a/1", first[0], "text/xml", first[1]), ("https://a/2", 200, "text/xml", rss(entry(1), entry(2)))]
    got = gather.source_entries(s, web(spark, pages), 5).collect()
    assert {r["rank"] for r in got} == {rank} and {r.title for r in got} == ({"T9"} if rank == 0 else {"T1", "T2"})


def test_search_is_the_last_resort(spark):
    s = sources(spark, "https://a/1")
    urls = [r.url for r in gather.candidates(s).orderBy("rank").collect()]
    assert urls[0] == "https://a/1" and len(urls) == 5 and all("search?q=" in u for u in urls[1:])
    pages = [(u, 200, "text/xml", rss(entry(i))) for i, u in enumerate(urls) if i >= 2]
    assert [r["rank"] for r in gather.source_entries(s, web(spark, pages), 5).collect()] == [2]
    assert gather.source_entries(s, web(spark, []), 5).count() == 0


def test_gather_oversamples_selects_and_filters(spark):
    s = sources(spark, "https://a/1").unionByName(sources(spark, "https://b/1", key="b")).unionByName(sources(spark, "https://c/1", key="c", language="fr"))
    pages = [(f"https://{k}/1", 200, "", rss(*[entry(i, k) for i in range(1, 10)], ("none", f"https://{k}/x", ""))) for k in "abc"]
    g = lambda *a, **b: gather.gather(s, web(spark, pages), *a, **b).collect()
    assert {r.source_key for r in g("en", 1)} == {"a", "b"} and len(g("en", 1)) == 8
    assert sorted(r.place for r in g("en", 1, ("a", "c"))) == [1, 2, 3, 4] and not g("en", 1, ("c",))
    last = max(g("en", 5, ("a",), oversample=0), key=lambda r: r.place)
    assert last.place == 5 and last.title == "T5"
    assert max(g("fr", 9), key=lambda r: r.place).title == "none" and not g("fr", 9, topic="sports")


def test_articles_by_type_size_link_and_image(spark):
    page = f'<html><head><meta property="og:image" content="https://i/1.png"></head><body><article>{LONG}</article></body></html>'.encode()
    late = b"<html><body><!--" + b"x" * gather.TEXT_BYTES + b"-->" + page
    kinds = [("ok", "text/html", page), ("xml", "application/xhtml+xml; charset=utf-8", page), ("pdf", "application/pdf", page), ("none", None, page), ("late", "text/html", late), ("gone", "text/html", page)]
    pages = [(f"https://a/{n}", 404 if n == "gone" else 200, k, b) for n, k, b in kinds]
    rows = [("a", f"https://a/{n}", "", "en") for n, *_ in kinds] + [("a", "https://a/missing", "https://own/2.png", "en"), ("a", "https://news.google.com/articles/r1", "", "en")]
    entries = spark.createDataFrame(rows, "source_key string, link string, image_url string, language string")
    redirects = spark.createDataFrame([("https://news.google.com/articles/r1", "https://news.google.com/articles/r2"), ("https://news.google.com/articles/r2", "https://a/ok")], "url string, target string")
    got = {r.link.rsplit("/")[-1]: r for r in gather.articles(entries, web(spark, pages), redirects).collect()}
    full = {k for k, r in got.items() if r.article_text.startswith("The council met on Tuesday")}
    assert full == {"ok", "xml", "r1"} and all(not r.article_text for k, r in got.items() if k not in full | {"late"})
    assert "council" not in got["late"].article_text  # it begins behind the bytes that are read
    assert got["ok"].image_url == "https://i/1.png" and got["missing"].image_url == "https://own/2.png" and got["r1"].resolved_url == "https://a/ok"


def test_gathered_articles_equal_the_pages_read_alone(spark):
    from newsloom.functions import article as ar
    from newsloom.plans.articles import e8_article_text

    got = gather.e11_gathered_articles(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    small = F.length(F.encode("html", "UTF-8")) <= gather.TEXT_BYTES
    text = e8_article_text(spark, SF).join(pages.where(small), "page_id").select("page_id", "url", ar.source_cleanup(F.col("text"), F.lit(""), F.col("url")).alias("text")).collect()
    alone = {r.url: "" if r.page_id % 7 == 0 else r.text for r in text}
    held = [r for r in got if r.resolved_url in alone]
    assert len(held) > 20 and all(r.article_text == alone[r.resolved_url] for r in held)


# --- links -----------------------------------------------------------------------------------------


def article_link(url, prefix="rss/articles", head=b'\x08\x13"'):
    raw = url.encode()
    size = bytes([len(raw)]) if len(raw) < 128 else bytes([len(raw) & 127 | 128, len(raw) >> 7])
    return f"https://news.google.com/{prefix}/" + base64.urlsafe_b64encode(head + size + raw + b"\xd2\x01\x00").decode().rstrip("=") + "?oc=5"


def test_ids_hold_urls(spark):
    cases = {
        article_link("https://www.example.org/a?b=1"): "https://www.example.org/a?b=1",
        article_link("https://x.org/" + "long/" * 60, "articles"): "https://x.org/" + "long/" * 60,
        article_link("https://x.org/é", "read"): "https://x.org/é",
        article_link("ftp://x.org/a"): None,
        article_link("https://x.org/a", head=b"\x08\x14!"): None,
        "https://news.google.com/rss/articles/not*base64": None,
        "https://news.google.com/rss/articles/CBMi": None,
        "https://news.google.com/topstories": None,
        "https://example.org/articles/CBMi": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.out for r in df.select("url", links.embedded_url(links.article_id(F.col("url"))).alias("out")).collect()} == cases


def test_redirects_end_turn_and_merge(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(37)]
    rows = [*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("self", "self"), ("two", "z"), ("two", "n0"), ("two", None), (None, "n1"), ("n5", "n6")]
    got = {r.url: (r.end, r.hops) for r in links.redirect_ends(spark.createDataFrame(rows, "url string, target string")).collect()}
    want = {f"n{i}": ("n37", 37 - i) for i in range(37)} | {k: (k, -1) for k in ("a", "b", "c", "into", "self")} | {"two": ("n37", 38)}
    assert got == want
    assert links.redirect_ends(spark.createDataFrame([], "url string, target string")).count() == 0


# --- feeds that no XML reader takes ------------------------------------------------------------------

BROKEN = """<rss><channel><title>c</title>
<item><title>One <b>bold</title><link>https://a/1</link><description><![CDATA[<p>Text & <i>more</i></p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000
<item><title>Two &amp; a half<link rel="self" href="https://a/self"/><link rel='alternate' href='https://a/2'/><summary>short</summary><content>long</content><updated>2024-01-02T00:00:00Z</updated></item>
<item><title>Three</title><guid>https://a/3</guid><author><title>not this</title><link>https://nobody</link></author><media:content url="https://i/3.png" type="image/png"/></item>
<item><title>Four</title><link rel="enclosure" href="https://a/4.mp3"/></item>
<item><title>No link</title></item><item><link>https://a/5</link></item>
<item><title>Six</title><link>https://a/6</link><dc:date>2024-01-06"""


def test_recovered_entries():
    got = feeds.parse_feed(BROKEN.encode())
    assert [(t, u) for t, u, *_ in got] == [("One bold", "https://a/1"), ("Two & a half", "https://a/2"), ("Three", "https://a/3"), ("Four", "https://a/4.mp3"), ("Six", "https://a/6")]
    assert got[0][2] == "Text & more" and got[0][4].startswith("Mon, 01 Jan 2024") and got[1][2] == "short" and got[1][4] == "2024-01-02T00:00:00Z"
    assert got[2][3] == "https://i/3.png" and got[4][4] == "2024-01-06"
    assert feeds.recovered("") == [] and feeds.recovered("<item") == []


def test_recovery_takes_linear_time():
    feeds.recovered("<item><title>" + "<a \"" * 200_000)
    feeds.recovered("<item><link href='" * 100_000)
    feeds.recovered("<![CDATA[" * 200_000)


# --- the data source ---------------------------------------------------------------------------------


def test_stored_feeds_as_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(StoredFeeds)
    put = lambda key, name, data: ((tmp_path / "in" / key).mkdir(parents=True, exist_ok=True), (tmp_path / "in" / key / name).write_bytes(data))
    put("a", "001.xml", rss(entry(1), entry(2)))
    put("b", "001.xml", BROKEN.encode())
    put("c", "001.xml", b"")
    batch = spark.read.format("stored_feeds").load(str(tmp_path / "in"))
    assert batch.rdd.getNumPartitions() == 3 and batch.groupBy("source_key").count().orderBy("source_key").collect() == [("a", 2), ("b", 5)]

    def run():
        stream = spark.readStream.format("stored_feeds").load(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((r.source_key, r.file, r.title) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 7
    put("a", "002.xml", rss(entry(3)))
    put("d", "001.xml", rss(entry(4)))
    assert run() == sorted([*first, ("a", "002.xml", "T3"), ("d", "001.xml", "T4")])
    assert len(run()) == 9

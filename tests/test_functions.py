"""Literal cases for branches that the tables don't reach."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import article, metrics, text
from newsloom.plans import catalog, corpus, feed
from newsloom.sources import feeds


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def cases():
    return [
        (text.unescape(F.lit("&amp;amp;lt;"), 4), "<"),
        (text.unescape(F.lit("a &amp; b")), "a & b"),
        (text.normalize(F.lit(" a&nbsp; b\n")), "a b"),
        (text.sentences(F.lit("A b. C d!E 3.14 x")), ["A b.", "C d!", "E 3.", "14 x"]),
        (text.sentences(F.lit("")), []),
        (text.cjk_count(F.lit("漢字かな한글")), 6),
        (text.word_like_count(F.lit("漢字かな한글")), 3),
        (text.word_like_count(F.lit("don't stop-and go")), 3),
        (text.overlap(text.word_set(F.lit("alpha beta gamma")), text.word_set(F.lit("gamma beta alpha"))), 1.0),
        (text.near_duplicate(F.lit("Alpha beta gamma"), F.lit("gamma Beta alpha")), True),
        (text.near_duplicate(F.lit(""), F.lit("")), False),
        (text.metadata_sentence(F.lit("Son güncelleme: 01.02.2024 10:00"), "tr"), True),
        (text.metadata_sentence(F.lit("A sentence about something that is not a note."), "en"), False),
        (text.metadata_sentence(F.lit("12.01.2024 / 10:30"), "en"), True),
        (text.datetime_like(F.lit("am 3 Ağustos")), True),
        (text.mojibake_count(F.lit("Ã¼")), 3),
        (text.mojibake_count(F.lit("plain")), 0),
        (text.boilerplate(F.lit("We use cookies here")), True),
        (text.boilerplate(F.lit("home news world politics business health science")), True),
        (text.boilerplate(F.lit("")), True),
        (text.code_noise(F.lit("a { b: c; } d { e: f; g: h }")), True),
        (text.code_noise(F.lit("let us go")), True),
        (text.sentence_ending(F.lit('He said "go."')), True),
        (text.sentence_ending(F.lit("no end")), False),
        (text.strip_html(F.lit("<p>a<b>c</b></p>")), "a c"),
        (feed.parse_rfc822(F.lit("Mon, 05 Feb 2024 10:11:12 +0200")).cast("string"), "2024-02-05 08:11:12"),
        (feed.parse_rfc822(F.lit("nonsense")), None),
        (feed.parse_iso(F.lit("2024-02-05T10:11:12Z")).cast("string"), "2024-02-05 10:11:12"),
        (corpus.image_of(F.lit('<meta content="u" property="og:image">')), "u"),
        (corpus.image_of(F.lit('<article><p><img class="x" src="i.png"></p></article>')), "i.png"),
        (catalog.infer_topic(F.lit("k"), F.lit("Foo Politics"), F.lit(""), F.lit("")), "general"),
        (catalog.infer_topic(F.lit("k"), F.lit("Foo"), F.lit(""), F.lit(" Sports ")), "sports"),
        (catalog.slugify(F.lit("  Año Nuevo & Co! ")), "a_o_nuevo_co"),
        (catalog.quote_plus(F.lit("a~b*c d")), "a~b%2Ac+d"),
        (article.degenerate(F.lit("word " * 20)), True),
        (article.degenerate(F.lit("one two three")), False),
        (article.finalize(F.lit("It ends."), F.lit("x")), "It ends."),
        (article.finalize(F.lit("A long enough first sentence here. And a"), F.lit("x")), "A long enough first sentence here."),
        (article.finalize(F.lit("no end"), F.lit("")), "no end."),
        (article.dedupe_segments(F.array(F.lit("alpha beta gamma"), F.lit("gamma beta alpha"), F.lit("other words entirely"))), ["alpha beta gamma", "other words entirely"]),
        (article.score(F.lit("")), -10000.0),
        (article.source_cleanup(F.lit("Read more . Text body xem thêm"), F.lit("k"), F.lit("https://www.vnexpress.net/a")), "Text body"),
        (metrics.tokens(F.lit("It's 漢字 ok")), ["it's", "漢", "字", "ok"]),
        (metrics.repetition(metrics.tokens(F.lit("a b c a b c")), 3), 0.25),
        (metrics.novelty(metrics.tokens(F.lit("a b x")), metrics.tokens(F.lit("a b c")), 1), pytest.approx(1 / 3)),
        (metrics.ideal_length(F.lit(16.0), F.lit("en")), 1.0),
        (metrics.ideal_length(F.lit(4.0), F.lit("en")), 0.5),
        (metrics.syllables(F.lit("cake")), 1),
    ]


def test_values(spark):
    made = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(made)]).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(made) if row[i] != want]
    assert not wrong


def test_long_sentence_is_cut_at_a_space(spark):
    got = value(spark, article.extractive(F.lit("word " * 100 + "end."), 280))
    assert got.endswith("word...") and len(got) <= 283


def test_dynamic_programming_metrics():
    assert metrics._lcs(list("abcbdab"), list("bdcaba")) == 4
    assert metrics._lcs([], ["a"]) == 0
    assert metrics._bleu(list("abcdefgh"), list("abcdefgh")) == pytest.approx(1)
    assert metrics._bleu(list("abcd"), []) == 0
    n = 6
    assert metrics._meteor(list("abcdef"), list("abcdef")) == pytest.approx(1 - 0.5 * (1 / n) ** 3)
    assert metrics._meteor(["a"], ["b"]) == 0
    assert metrics._fragments(list("abcxyz"), list("abcq")) == (0.75, 9 / 4)


def test_budgets(spark):
    langs = spark.createDataFrame([(k, i) for i, k in enumerate("abc")], "language string, idx int")
    assert [r.budget for r in feed.language_budgets(langs, 7).orderBy("idx").collect()] == [3, 2, 2]
    assert [r.budget for r in feed.language_budgets(langs, 2).orderBy("idx").collect()] == [1, 1, 0]


def test_round_robin(spark):
    rows = spark.createDataFrame(list(enumerate("aaabcc")), "pos int, source string")
    assert [r.source for r in feed.round_robin(rows, "source", "pos").orderBy("turn_order").collect()] == list("abcaca")


def test_admission(spark):
    rows = [("en", "a", 1, True, True), ("en", "a", 2, True, True), ("en", "b", 3, False, True), ("en", "b", 4, True, False), ("en", "b", 5, True, True), ("en", "c", 6, True, True)]
    entries = spark.createDataFrame(rows, "language string, source_key string, pos long, in_range boolean, success boolean")
    budgets = spark.createDataFrame([("en", 3)], "language string, budget int")
    got = [r.decision for r in feed.admit(entries, 1, budgets).orderBy("pos").collect()]
    assert got == ["admitted", "source_cap", "out_of_range", "failed", "admitted", "over_budget"]


def test_keyword():
    assert feed.keyword_required(" one ") == "one"
    for bad in ("", "two words"):
        with pytest.raises(ValueError, match="single word"):
            feed.keyword_required(bad)
    assert feed.pre_limit(0, 10, 5) == 300 and feed.pre_limit(1, 10, 1) == 20 and feed.pre_limit(100, 1, 15) == 1000


RSS = b"""<?xml version="1.0"?><rss><channel><item><title>A</title><link>http://x/1</link><pubDate>Mon, 05 Feb 2024 10:11:12 +0200</pubDate>
<enclosure url="http://x/i.jpg" type="image/jpeg"/></item><item><title>B & C</title><guid>http://x/2</guid><description>&lt;img src="d.png"&gt; text</description></item></channel></rss>"""
ATOM = b"""junk<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="http://x/s"/><link rel="alternate" href="http://x/e"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"""


def test_feeds(spark):
    found = feeds.entries(spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("bad", b"<a>"), ("none", None)], "source_key string, content binary"))
    rows = {r.title: r for r in found.collect()}
    assert set(rows) == {"A", "B & C", "E"}
    assert rows["A"].link == "http://x/1" and rows["A"].image_url == "http://x/i.jpg" and str(rows["A"].published_at) == "2024-02-05 08:11:12"
    assert rows["B & C"].link == "http://x/2" and rows["B & C"].image_url == "d.png" and rows["B & C"].published_at is None
    assert rows["E"].link == "http://x/e" and str(rows["E"].published_at) == "2024-01-02 03:04:05"
    assert [r.title for r in feeds.newest(found, 2).collect()] == ["A", "E"]


def test_streaming_ingest(spark, tmp_path):
    from newsloom.streaming.ingest import Store, start

    columns = "id long, link string, title string, published_at string, image_url string, article_text string, fetched_at string"
    source = tmp_path / "in"

    def put(rows, name):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"file://{source}")

    store = Store(spark, f"file://{tmp_path}/items")
    put([(1, "a", "t1", "2024", "img", "text", "f1"), (2, "b", "t2", None, "", "x", "f1")], "one")
    stream = lambda: spark.readStream.schema(columns).parquet(f"file://{source}")
    start(stream(), store, f"file://{tmp_path}/cp").awaitTermination()
    put([(9, "a", "new", None, "", "", "f2"), (3, "c", "t3", None, "", "y", "f2")], "two")
    start(stream(), store, f"file://{tmp_path}/cp").awaitTermination()
    got = {r.link: r for r in store.read().collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].id, got["a"].title, got["a"].published_at, got["a"].image_url, got["a"].article_text, got["a"].fetched_at) == (1, "new", "2024", "img", "text", "f2")


def test_files(spark, tmp_path):
    from newsloom.sources import tables

    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("r", "m", "1.5", "long text"), ("r", "n", "x", 'a "b"')], "run_name string, model string, rouge string, source_text string")
    tables.write_scores(df, f"{root}/run")
    got = {r.model: r.rouge for r in tables.read_scores(spark, f"{root}/run/csv").collect()}
    assert got == {"m": 1.5, "n": None}
    assert tables.read_scores(spark, f"{root}/run/csv").columns == ["run_name", "model", "rouge"]
    assert [r.source_text for r in tables.read_manifest(spark, f"{root}/run/csv").orderBy("model").collect()] == ["long text", 'a "b"']
    (tmp_path / "report").mkdir()
    (tmp_path / "report" / "a.json").write_text('[{"source_key": "a", "pass": true}, {"source_key": "b", "pass": false}, {"source_key": "c"}]')
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text('[{"source_key": "a", "pass": true}]')
    assert {r.source_key for r in tables.gated_keys(spark, [f"{root}/good", f"{root}/report"]).collect()} == {"b", "c"}
    assert tables.read_json_array(spark, f"{root}/good", "source_key string").count() == 1
    assert [x.split("/")[-1] for x in tables.discover_runs(spark, root, ("a.json",), ("good",))] == ["report"]
    assert tables.markdown(spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double").orderBy("k")).split("\n")[2:] == ["| a | 1.0000 |", "| b | - |"]
    manifest = spark.createDataFrame([("r", "c", "b.html", "50% & more"), ("r", "c", "a.png", "T_1")], "run string, category string, path string, title string")
    assert tables.appendix(manifest).first().latex == "\\includegraphics{a.png}\\caption{T\\_1}\n\\item 50\\% \\& more: b.html"


def test_decoding(spark):
    rows = [("ü ö".encode(), "text/html; charset=utf-8", "de"), ("ü ö".encode("cp1252"), "text/html; charset=windows-1252", "de"), ("日本語の文章です。かな".encode(), "text/html", "ja"), (b'<meta charset="euc-kr">' + "한국어".encode("euc-kr"), "", "ko"), (None, None, None)]
    df = spark.createDataFrame(rows, "data binary, header string, language string")
    got = [r.v for r in df.select(text.decode_html("data", "header", "language").alias("v")).collect()]
    assert got == ["ü ö", "ü ö", "日本語の文章です。かな", '<meta charset="euc-kr">한국어', ""]
    fixed = spark.createDataFrame([("Ã¼ber",), ("plain",), (None,)], "v string").select(text.repair_mojibake("v").alias("v"), text.normalize_extracted("v").alias("w")).collect()
    assert [(r.v, r.w) for r in fixed] == [("über", "über"), ("plain", "plain"), ("", "")]


def test_cleaning(spark):
    lit = F.lit
    assert value(spark, article.strip_prefix(lit("Updated: 12.01.2024 10:30 - Text"))) == "Text"
    body = "The exact title. The exact title has many more words that tell something new here today. Son güncelleme: 01.02.2024 10:00. Real text follows here."
    assert value(spark, article.clean_for_summary(lit(body), lit("en"), lit("The exact title"), lit(""), lit(""))).startswith("The exact title has many")
    assert value(spark, article.postprocess(lit("A Title: the rest of the summary is long enough."), lit("a title"), lit("en"))) == "The rest of the summary is long enough."
    assert value(spark, article.postprocess(lit("Same words here"), lit("here same words"), lit("en"))) == ""
    assert value(spark, catalog.min_article_chars(lit(400), lit("ja"))) == 280


def test_requests(spark):
    from newsloom.operators.requests import LANGUAGES, FeedRequest, RunSettings, load_news
    from newsloom.plans import fixtures as fx

    r = FeedRequest.of({"limit": "99", "sources": "src1, src2", "source": "x", "country": "us", "topic": "ALL", "keyword_enabled": "true", "keyword": "the"}, ("model_a",))
    assert (r.limit_per_source, r.sources, r.country, r.topic, r.keyword) == (15, ("src1", "src2"), "US", "", "the")
    for bad in ({"language": "xx"}, {"model": "none"}, {"keyword_enabled": "true", "keyword": "a b"}):
        with pytest.raises(ValueError, match="invalid|single"):
            FeedRequest.of(bad, ("model_a",))
    s = RunSettings.of({"INGEST_LANGUAGES": "FR, xx", "INGEST_LIMIT_PER_SOURCE": "900", "INGEST_INTERVAL_SECONDS": "5"}, ("m",))
    assert (s.languages, s.limit_per_source, s.fetch_limit_per_source, s.interval_seconds, s.models) == (("fr",), 500, 500, 60, ("m",))
    assert RunSettings.of({}, ("m",)).languages == LANGUAGES
    sf = "/root/testdata/sf0.001"
    rows = load_news(fx.news_items(spark, sf), fx.news_summaries(spark, sf), r, 20).collect()
    assert rows and {x.source_key for x in rows} <= {"src1", "src2"} and all("summary" in x for x in rows)


def test_translation_hook(spark):
    known = ("en", "fr")
    same = value(spark, corpus.translated(F.lit("x"), F.lit("en"), F.lit("fr"), known))
    assert (same.text, same.translation_applied) == ("x", False)
    shout = lambda t, a, b: F.upper(t)
    assert value(spark, corpus.translated(F.lit("x"), F.lit("en"), F.lit("fr"), known, shout)).translation_applied
    assert value(spark, corpus.translated(F.lit("x"), F.lit("en"), F.lit("xx"), known, shout)).text == "x"


def test_noise_filter_tests_lengths_first(spark):
    """Only sentences short enough for a note are searched for notes' patterns."""
    from newsloom.plans import articles

    plan = articles.t18_filter_noise(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.index("<= 140") < plan.index("last updated")

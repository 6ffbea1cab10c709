"""Texts read in Python against the column expressions that say the same."""

import random
import sys

from pyspark.sql import functions as F

from newsloom.functions import article as ar
from newsloom.functions import prose
from newsloom.functions import text as tx

SF = "/root/testdata/sf0.001"
PIECES = (
    "The council met on Tuesday and agreed on a plan for the new bridge across the river", "Work starts next spring if money arrives", "Nobody objected when engineers explained costs",
    "Son Güncelleme: 12.01.2024 10:30", "last updated: May 3", "published: 2024-01-12", "12:30", "SAAT: 10:30", "Cookies and more", "GİZLİLİK POLİTİKASI", "gizlilik politikası", "ABONE OL", "kullanım koşulları",
    "home news world politics business health", "weather travel", "Foto Galeri spor gündem", "dolar 32,5", "let x = 1;", "a variable", "FUNCTİON f", "{a: b; c: d; e: f}", '{"a":1,"b":2,"c":3,"d":4}, {"e":5}',
    '"a","b","c","d","e","f":1:2:3:4:5:6:7:8', '{"@context": "https://schema.org"', "<path d", "<SPAN class", "position : fixed", "data-styled", "Ã¼ber â€™s Â° ä\u0080\u0080\u0080", "東京で会議が開かれました", "中文新闻",
    "don't re-read well-known -x- 'quoted'", "Kelvin K ſign in", "İstanbul'da ışık", "naïve Straße ẞ", "ὀδός", "Θεσσαλονίκη", "ΣΟΦΟΣ", "\U0001f600", "\U00020000\U0001e900", "a​b\x07c d　e", "½ ² Ⅷ", "म हिन्दी", "العربية ١٢",
)


def _texts(n: int) -> list[str]:
    rng = random.Random(5)
    out = ["", " ", "| |", "...", "a | b", "x" * 30]
    for _ in range(n):
        said = rng.choices(PIECES, k=rng.choice((1, 2, 3, 6, 12, 30)))
        out.append("".join(p + rng.choice((". ", "! ", ".", " | ", " ", "? ", "。", "\n", " ... ", ", ")) for p in said))
    return out


def _same(spark, rows, kind, by_python, by_columns):
    df = spark.createDataFrame([(r,) for r in rows], f"t {kind}").repartition(4)
    got = df.select("t", by_python(F.col("t")).alias("a"), by_columns(F.col("t")).alias("b")).collect()
    assert len(got) == len(rows) and [r.t for r in got if r.a is not None and r.a != r.b] == []
    return sum(r.a is not None for r in got)


def test_filter_equals_its_columns(spark):
    read = _same(spark, [*_texts(1500), None], "string", lambda t: prose.filtered(t.cast("binary")), lambda t: ar.filter_noise_by_columns(tx.clean(t)))
    assert read > 700


def test_readable_characters_are_the_same_in_java(spark):
    read = [(c,) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and prose.readable(c)]
    assert len(read) > 30_000
    c = F.col("c")
    folds = F.concat(*[c.rlike(f"(?iu)^{x}$").cast("int").cast("string") for x in "abcdefghijklmnopqrstuvwxyzçğışöü"])
    got = spark.createDataFrame(read, "c string").select("c", F.lower(c).alias("low"), c.rlike(tx.WORD).alias("word"), tx.clean(F.concat(F.lit("a"), c, F.lit("b"))).alias("clean"), folds.alias("folds")).collect()
    import re

    letters = [re.compile(f"(?i){x}") for x in "abcdefghijklmnopqrstuvwxyzçğışöü"]
    for r in got:
        assert (r.low, r.word, r.clean) == (r.c.lower(), re.match(r"\w", r.c) is not None, prose.clean(f"a{r.c}b")), hex(ord(r.c))
        assert r.folds == "".join(str(int(x.fullmatch(r.c) is not None)) for x in letters), hex(ord(r.c))


def test_t18_takes_odd_texts_whole(spark, tmp_path):
    """Texts that aren't for Python (and bytes that are no UTF-8) go by the columns; null is empty."""
    from newsloom.plans import articles

    said = "The council met on Tuesday and agreed on a plan for the new bridge. Work starts next spring if the money arrives from the state in time. Subscribe now to our newsletter."
    texts = [said.encode(), (said + " Then spoke ΣΟΦΟΣ of the \U0001e900.").encode(), b"\xff\xfe" + said.encode(), None, b""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in articles.t18_filter_noise(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[0] == said.split(" Subscribe")[0] and got[1] == got[0] + " Then spoke ΣΟΦΟΣ of the \U0001e900." and got[2].endswith(got[0]) and got[3] == got[4] == ""


def test_t18_needs_no_columns_for_the_tables(spark, monkeypatch):
    """Each sentence was an interpreted fold of the JVM, which took too long over large tables."""
    from newsloom.plans import articles

    monkeypatch.setattr(ar, "filter_noise_by_columns", lambda t: F.raise_error(F.lit("left to columns")).cast("string"))
    assert articles.t18_filter_noise(spark, SF).where("text is not null").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_best_equals_its_columns(spark):
    texts = _texts(900)
    rng = random.Random(6)
    rows = [[*rng.choices(texts, k=rng.choice((1, 2, 3)))] for _ in range(500)] + [[], None, [None, ""], ["x", None]]
    assert _same(spark, rows, "array<string>", lambda t: prose.picked(t.cast("array<binary>")), ar.pick_best_by_columns) > 150


def test_scores_equal_their_columns_and_count_dotless_letters(spark):
    """A phrase with a dotless i was never counted, as its beginning was looked for in a text without such letters."""
    said = "Work starts next spring if money arrives. " * 6
    texts = [said + x for x in ("", "gizlilik politikası.", "Kullanım Koşulları.", "GRAM ALTIN.", "Gizlilik Politikasi.")] + [t for t in map(prose.clean, _texts(600)) if prose.readable(t)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", ar.score(F.col("t")).alias("s")).collect()
    assert [r.t for r in rows if abs(r.s - prose.score(r.t, prose.Memo())) > 1e-9] == []
    counted = spark.createDataFrame([(t,) for t in texts[:5]], "t string").select(tx.hits(F.col("t"), [f"{tx.LEFT}(?:{p}){tx.RIGHT}" for p in tx.BOILERPLATE]).alias("n")).collect()
    assert [r.n for r in counted] == [0, 1, 1, 1, 1]


def test_t20_needs_no_columns_for_the_tables(spark, monkeypatch):
    from newsloom.plans import articles

    monkeypatch.setattr(ar, "pick_best_by_columns", lambda c: F.raise_error(F.lit("left to columns")).cast("string"))
    assert articles.t20_pick_best(spark, SF).where("text is not null").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def _page(rng, pick: bool) -> str:
    pool = [p for p in PIECES if prose.readable(p) or pick]
    pool = [f"{x}." for x in pool] + [f"{x} and number {i} of the things that were said at length about it all." for i, x in enumerate(pool)]
    said = lambda: " ".join(rng.choices(pool, k=rng.choice((1, 2, 4))))
    linked = lambda: "".join(f'<a href="/{i}">{rng.choice(pool)}</a> ' for i in range(3))
    kinds = (
        lambda: f"<p>{said()}</p>", lambda: f"<p>{linked()}</p>", lambda: f"{said()}<br>{said()}<br/>", lambda: f"<article>{said()}<p>{said()}</p><p>{said()}</p></article>",
        lambda: f'<div class="story-body"><p>{said()}</p>{linked()}</div>', lambda: f"<nav>{linked()}</nav>", lambda: "<body>", lambda: "</body>", lambda: "&amp;amp; &eacute; &#x391; ",
        lambda: '<script type="application/ld+json">{"articleBody": "' + said().replace('"', "") * 2 + rng.choice(("\\u00e9", "\\u03a3", "\\ud800", "")) + '"}</script>',
    )
    return "".join(rng.choice(kinds)() for _ in range(rng.randrange(12)))


def test_articles_equal_their_columns(spark, tmp_path):
    """With pages that hold half a character as an escape, which failed the query."""
    from newsloom.functions import html
    from newsloom.plans import articles

    rng = random.Random(7)
    pages = [_page(rng, i % 4 == 0) for i in range(400)] + [None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    df = spark.read.parquet(f"{tmp_path}/pages.parquet").withColumn("parts", html.parts(tx.collapse(tx.unescape(F.col("html"), 4))))
    slow = {r.page_id: r.text for r in df.select("page_id", html.article_text(F.col("parts")).alias("text")).collect()}
    got = {r.page_id: r.text for r in articles.e8_article_text(spark, str(tmp_path)).collect()}
    assert got == slow and len(got) == 402 and sum(map(bool, got.values())) > 200
    assert sum(html._article((p or "").encode()) is not None for p in pages) > 150


def test_e8_needs_no_columns_for_the_tables(spark, monkeypatch):
    from newsloom.functions import html
    from newsloom.plans import articles

    monkeypatch.setattr(html, "article_text", lambda read: F.raise_error(F.lit("left to columns")).cast("string"))
    assert articles.e8_article_text(spark, SF).where("text is not null").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_memo_that_fills_up_changes_nothing(monkeypatch):
    texts = [[prose.clean(t) for t in _texts(60)[i::7]] for i in range(7)]
    want = [prose.pick_best(t, prose.Memo()) for t in texts]
    monkeypatch.setattr(prose.Memo, "FULL", 3)
    assert [prose.pick_best(t, prose.Memo()) for t in texts] == want and any(want)

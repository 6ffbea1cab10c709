"""Gathering: from sources and stored responses to entries, and from entries to article texts and images.

``sources``: source_key, name, language, topic, country, region, site_domain, rss_urls (array). ``responses``: one row for each URL that was
fetched, with status, content_type and body (binary). Nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import article as ar
from newsloom.functions import html, links
from newsloom.functions import text as tx
from newsloom.plans import catalog
from newsloom.plans.corpus import image_of
from newsloom.plans.feed import filter_sources
from newsloom.session import table
from newsloom.sources import feeds

#: Entries read for each one that is asked for; characters of an article; bytes read for an article and for its image.
OVERSAMPLE = 4
TEXT_BYTES, IMAGE_BYTES = 4 * ar.MAX_ARTICLE_CHARS, 2 * ar.MAX_ARTICLE_CHARS
LANGUAGES = ("en", "fr", "de", "es")


# --- operators ------------------------------------------------------------------------------------


def candidates(sources: DataFrame) -> DataFrame:
    """source_key, rank, url: a source's own feeds in order, then its news-search feeds."""
    searches = catalog.fallback_urls(F.col("source_key"), F.col("name"), F.col("site_domain"), F.col("topic"), F.col("language"), F.col("country"))
    return sources.select("source_key", F.posexplode(F.concat("rss_urls", searches)).alias("rank", "url"))


def answered(responses: DataFrame) -> DataFrame:
    return responses.where((F.col("status") < 400) & (F.length("body") > 0))


def first_fed(entries: DataFrame) -> DataFrame:
    """The entries of each source's first feed that has any."""
    first = entries.groupBy("source_key").agg(F.min("rank").alias("first"))
    return entries.join(first, "source_key").where("rank = first").drop("first")


def source_entries(sources: DataFrame, responses: DataFrame, limit: int) -> DataFrame:
    """source_key, rank, entry columns and place: the newest ``limit`` entries of each source, dateless ones last.

    All candidates of a source are read side by side; a feed is used only if none before it has entries.
    """
    asked = candidates(sources).join(answered(responses).select("url", F.col("body").alias("content")), "url")
    found = first_fed(feeds.entries(asked))
    order = Window.partitionBy("source_key").orderBy(F.coalesce("published_at", F.timestamp_seconds(F.lit(0))).desc(), "link")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def gather(sources: DataFrame, responses: DataFrame, language: str, limit: int, selected: tuple[str, ...] = (), oversample: int = OVERSAMPLE, **asked: str) -> DataFrame:
    """Entries of the sources of a language (and topic, country, region), of the selected ones only if any is; more than ``limit`` each, for later loss."""
    chosen = filter_sources(sources, language, **asked)
    if selected:
        chosen = chosen.where(F.col("source_key").isin(*selected))
    found = source_entries(chosen, responses, max(1, limit * max(1, oversample)))
    return found.join(chosen.select("source_key", "name", "language"), "source_key")


def is_page(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("text/html") | kind.contains("application/xhtml+xml")


def articles(entries: DataFrame, responses: DataFrame, redirects: DataFrame) -> DataFrame:
    """Entries with resolved_url, article_text and image_url.

    A page is read once for each (URL, language): its first bytes decoded by their charset, references read, the best candidate taken.
    Without a page (failed, other content type) the text is ''. An entry's own image wins over the page's.
    """
    named = links.resolved(entries, "link", redirects)
    wanted = named.select(F.col("resolved_url").alias("url"), "language").distinct()
    pages = wanted.join(answered(responses).where(is_page(F.col("content_type"))).select("url", "content_type", "body"), "url")
    head = lambda n: tx.decode_html(F.substring("body", 1, n), F.col("content_type"), F.col("language"))
    heads = pages.select("url", "language", head(TEXT_BYTES).alias("page"), tx.collapse(tx.unescape(head(IMAGE_BYTES), 4)).alias("start"))
    read = html.with_article(heads, "page", "text").select("url", "language", "text", image_of(F.col("start")).alias("page_image"))
    joined = named.join(read, (F.col("resolved_url") == F.col("url")) & named["language"].eqNullSafe(read["language"]), "left").drop(read["language"]).drop("url")
    text = F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(ar.source_cleanup(F.col("text"), F.col("source_key"), F.col("resolved_url")))
    image = F.coalesce(F.nullif("image_url", F.lit("")), "page_image", F.lit(""))
    return joined.withColumns({"article_text": text, "image_url": image}).drop("text", "page_image")


# --- queries: a web made of the pages table ---------------------------------------------------------
# Every host is a source. By the length of its name modulo 4: its first feed answers; the first is missing and the second an Atom
# feed; the first is empty and the second damaged; or only the news search answers.

EPOCH, FEED_ROWS = 1704067200, 50


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    language = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    return p.select("page_id", "url", "html", host.alias("host"), F.when(language.isin(*LANGUAGES), language).otherwise("en").alias("language"))


def web_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts; a host's language is that of its smallest page."""
    h = _hosted(spark, sf_dir).groupBy("host").agg(F.min_by("language", "page_id").alias("language"))
    urls = F.array(*[F.concat(F.lit("https://"), "host", F.lit(end)) for end in ("/feed.xml", "/atom.xml")])
    return h.select(F.col("host").alias("source_key"), F.upper("host").alias("name"), "language", F.lit("general").alias("topic"), F.lit("US").alias("country"), F.lit("global").alias("region"), F.col("host").alias("site_domain"), urls.alias("rss_urls"))


def aggregated(page: Column, url: Column) -> Column:
    """Links of every fifth page go through the aggregator: by an id that holds the URL (short ones), or by redirects."""
    size = F.length(F.encode(url, "UTF-8"))
    head = F.unhex(F.concat(F.lit(links.ID_HEAD), F.lpad(F.hex(size), 2, "0")))
    id_ = F.translate(F.regexp_replace(F.base64(F.concat(head, F.encode(url, "UTF-8"), F.unhex(F.lit("D20100")))), "[\\r\\n=]", ""), "+/", "-_")
    held = F.concat(F.lit(f"https://{links.AGGREGATOR}/rss/articles/"), id_)
    return F.when((page % 10 == 0) & (size < 128), held).when(page % 5 == 0, F.concat(F.lit(f"https://{links.AGGREGATOR}/articles/r"), page.cast("string"))).otherwise(url)


def web_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of one to eight hops from an aggregator's link to the page; every 25th turns in a circle."""
    p = _hosted(spark, sf_dir).where("page_id % 5 = 0").select("page_id", "url")
    hops = (F.col("page_id") % 8 + 1).cast("int")
    at = lambda i: F.concat(F.lit(f"https://{links.AGGREGATOR}/articles/r"), F.col("page_id").cast("string"), F.when(i > 0, F.concat(F.lit("/"), i.cast("string"))).otherwise(""))
    rows = p.select("page_id", "url", hops.alias("hops"), F.explode(F.sequence(F.lit(0), hops - 1)).alias("i"))
    end = F.when(F.col("page_id") % 25 == 0, at(F.lit(0))).otherwise(F.col("url"))
    return rows.select(at(F.col("i")).alias("url"), F.when(F.col("i") == F.col("hops") - 1, end).otherwise(at(F.col("i") + 1)).alias("target"))


def web_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of the newest pages of each host, and the pages themselves; every seventh page is no HTML."""
    h = _hosted(spark, sf_dir)
    newest = h.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.col("page_id").desc()))).where(F.col("n") <= FEED_ROWS)
    kind = F.length("host") % 4
    when = F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") * 60)
    number = F.col("page_id").cast("string")
    link = aggregated(F.col("page_id"), F.col("url"))
    safe = F.replace(link, F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<item><title>Page "), number, F.lit(" &amp; more</title><link>"), F.when(kind == 2, link).otherwise(safe), F.lit("</link><description>"), F.when(kind == 2, F.lit("\x0btext & more")).otherwise(F.lit("text")), F.lit("</description><pubDate>"), F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>Page "), number, F.lit('</title><link rel="alternate" href="'), safe, F.lit('"/><updated>'), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    items = newest.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.when(kind == 1, atom).otherwise(rss))), "").alias("items"))
    channel = F.concat(F.lit("<rss><channel><title>t</title>"), "items", F.lit("</channel></rss>"))
    whole = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), "items", F.lit("</feed>"))
    search = links_search(F.col("host"))
    made = items.select(
        F.explode(
            F.when(kind == 0, F.array(_answer(F.lit("/feed.xml"), 200, channel)))
            .when(kind == 1, F.array(_answer(F.lit("/feed.xml"), 404, channel), _answer(F.lit("/atom.xml"), 200, whole)))
            .when(kind == 2, F.array(_answer(F.lit("/feed.xml"), 200, F.lit("<rss><channel/></rss>")), _answer(F.lit("/atom.xml"), 200, F.concat(F.lit("junk"), channel))))
            .otherwise(F.array(_answer(F.lit("/feed.xml"), 200, F.lit("")), F.struct(search.alias("url"), F.lit(200).alias("status"), F.lit("text/xml").alias("content_type"), channel.alias("text"))))
        ).alias("r")
    ).select("r.*")
    type_ = F.when(F.col("page_id") % 7 == 0, "application/pdf").when(F.col("page_id") % 7 == 1, "application/xhtml+xml; charset=utf-8").otherwise("text/html")
    pages = h.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p")).select("url", F.col("p.page_id").alias("page_id"), F.col("p.html").alias("html"))
    return made.unionByName(pages.select("url", F.lit(200).alias("status"), type_.alias("content_type"), F.col("html").alias("text"))).withColumn("body", F.encode("text", "UTF-8")).drop("text")


def links_search(host: Column) -> Column:
    """The first news search of a host's source, as ``candidates`` makes it."""
    return F.get(catalog.fallback_urls(host, F.upper(host), host, F.lit("general"), F.lit("en"), F.lit("US")), F.lit(0))


def _answer(path: Column, status: int, text: Column) -> Column:
    return F.struct(F.concat(F.lit("https://"), "host", path).alias("url"), F.lit(status).alias("status"), F.lit("text/xml").alias("content_type"), text.alias("text"))


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every language; sources count as English so that searches have one locale."""
    sources, responses = web_sources(spark, sf_dir).withColumn("language", F.lit("en")), web_responses(spark, sf_dir)
    return gather(sources, responses, "en", 3)


def s9_gathered_entries(spark, sf_dir):
    g = _gathered(spark, sf_dir)
    return g.select("source_key", F.col("rank").cast("long").alias("rank"), "title", "link", F.unix_timestamp("published_at").alias("published"), F.col("place").cast("long").alias("place"))


def s8_redirects(spark, sf_dir):
    return links.redirect_ends(web_redirects(spark, sf_dir))


def s8_resolved_links(spark, sf_dir):
    p = _hosted(spark, sf_dir).select("page_id", aggregated(F.col("page_id"), F.col("url")).alias("link"))
    return links.resolved(p, "link", web_redirects(spark, sf_dir)).select("page_id", "resolved_url")


def e11_gathered_articles(spark, sf_dir):
    found = articles(_gathered(spark, sf_dir), web_responses(spark, sf_dir), web_redirects(spark, sf_dir))
    return found.select("source_key", "link", "resolved_url", "article_text", "image_url")


QUERIES = {f.__name__: f for f in (s9_gathered_entries, s8_redirects, s8_resolved_links, e11_gathered_articles)}

_H = "h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, strlen(url) AS size FROM pages)"
_AGG = f"'https://{links.AGGREGATOR}/"
_HELD = f"{_AGG}rss/articles/' || translate(replace(to_base64(from_hex('{links.ID_HEAD}' || lpad(hex(size), 2, '0')) || encode(url) || from_hex('D20100')), '=', ''), '+/', '-_')"
_LINKED = f"l AS (SELECT *, CASE WHEN page_id % 10 = 0 AND size < 128 THEN {_HELD} WHEN page_id % 5 = 0 THEN {_AGG}articles/r' || page_id ELSE url END AS link FROM h)"
_AT = f"{_AGG}articles/r' || page_id || CASE WHEN i > 0 THEN '/' || i ELSE '' END"
ORACLE = {
    "s9_gathered_entries": f"""WITH {_H}, {_LINKED}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS place, length(host) % 4 AS kind FROM l)
SELECT host AS source_key, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS rank, 'Page ' || page_id || CASE WHEN kind = 1 THEN '' ELSE ' & more' END AS title, link, {EPOCH} + page_id * 60 AS published, place
FROM n WHERE place <= {3 * OVERSAMPLE}""",
    "s8_redirects": f"WITH {_H}, r AS (SELECT *, CAST(page_id % 8 AS INT) + 1 AS hops, unnest(range(CAST(page_id % 8 AS INT) + 1)) AS i FROM h WHERE page_id % 5 = 0), u AS (SELECT *, {_AT} AS own FROM r) SELECT own AS url, CASE WHEN page_id % 25 = 0 THEN own ELSE url END AS \"end\", CAST(CASE WHEN page_id % 25 = 0 THEN -1 ELSE hops - i END AS BIGINT) AS hops FROM u",
    "s8_resolved_links": f"WITH {_H}, {_LINKED} SELECT page_id, CASE WHEN page_id % 25 = 0 AND NOT (page_id % 10 = 0 AND size < 128) THEN link ELSE url END AS resolved_url FROM l",
}

"""Source catalog: keys, topics, countries and regions inferred from names and URLs; the best source of each site; validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import LEFT, RIGHT, collapse
from newsloom.session import table

# --- fixed values ---------------------------------------------------------------------------------------

TOPICS = ("general", "world", "politics", "business", "technology", "science", "health", "sports", "entertainment", "culture")
#: Country, its region.
COUNTRIES = {
    "AU": "oceania", "CA": "north_america", "CH": "europe", "EG": "middle_east", "AE": "middle_east", "DE": "europe", "ES": "europe", "FR": "europe", "GB": "europe",
    "IN": "asia", "IT": "europe", "JP": "asia", "KR": "asia", "NL": "europe", "QA": "middle_east", "RO": "europe", "RU": "europe", "SA": "middle_east", "SG": "asia",
    "TR": "europe", "US": "north_america", "VN": "asia", "CN": "asia",
}
REGIONS = ("global", "europe", "asia", "oceania", "middle_east", "north_america")
#: Topic words, in the order in which they are tried; "world" matches anywhere.
TOPIC_LADDER = (
    ("sports", "sport|spor|football|soccer|basket|tennis"),
    ("world", None),
    ("politics", "politic|siyaset|politique|politik|politica|полит|政治"),
    ("business", "business|econom|finance|ekonomi|wirtschaft|economia|finanza|эконом|财经"),
    ("technology", "tech|technology|teknoloji|technologie|tecnologia|технолог|科技"),
    ("science", "science|bilim|wissenschaft|ciencia|scienza|наука|科学"),
    ("health", "health|sağlık|saglik|sante|gesundheit|salud|salute|здоров|健康"),
    ("entertainment", "entertainment|magazin|show|celeb|娱乐|연예|मनोरंजन"),
    ("culture", "culture|kultur|kültür|cultura|文化|культура"),
)
FEED_LABELS = ("feeds", "feed", "rss", "news", "xml", "m")
#: Search locale of a language: interface language, country, edition.
LOCALES = {
    "ar": ("ar", "SA", "SA:ar"), "de": ("de", "DE", "DE:de"), "en": ("en-US", "US", "US:en"), "es": ("es", "ES", "ES:es"), "fr": ("fr", "FR", "FR:fr"), "hi": ("hi", "IN", "IN:hi"),
    "it": ("it", "IT", "IT:it"), "ja": ("ja", "JP", "JP:ja"), "ko": ("ko", "KR", "KR:ko"), "nl": ("nl", "NL", "NL:nl"), "ro": ("ro", "RO", "RO:ro"), "ru": ("ru", "RU", "RU:ru"),
    "tr": ("tr", "TR", "TR:tr"), "vi": ("vi", "VN", "VN:vi"), "zh": ("zh-CN", "CN", "CN:zh-Hans"),
}
#: Default country of a language, and countries of single sources.
LANGUAGE_COUNTRY = {"ar": "QA", "de": "DE", "en": "US", "es": "ES", "fr": "FR", "hi": "IN", "it": "IT", "ja": "JP", "ko": "KR", "nl": "NL", "ro": "RO", "ru": "RU", "tr": "TR", "vi": "VN", "zh": "CN"}
SOURCE_COUNTRY = {
    "aljazeera_world": "QA", "bbc_world": "GB", "cnn_world": "US", "dw_world": "DE", "fox_world": "US", "guardian_world": "GB", "npr_world": "US", "nyt_world": "US",
    "reuters_world": "US", "sky_world": "GB", "zh_zaobao": "SG",
}
DENSE_LANGUAGES = ("ja", "ko", "zh")
NEWS_SEARCH = "https://news.google.com/rss/search?"


def slugify(text: Column) -> Column:
    """C1."""
    return F.regexp_replace(F.regexp_replace(F.lower(collapse(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def quote_plus(text: Column) -> Column:
    """As an HTML form would; Spark's encoder differs on two characters."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(query: Column, language: Column, country: Column) -> Column:
    """The locale is the language's; a language without one searches in English for the country."""
    q, c = collapse(query), F.upper(F.coalesce(F.nullif(country, F.lit("")), F.lit("US")))
    locale = reduce(lambda a, kv: a.when(language == kv[0], F.lit(f"&hl={kv[1][0]}&gl={kv[1][1]}&ceid={kv[1][2].replace(':', '%3A')}")), LOCALES.items(), F)
    return F.concat(F.lit(NEWS_SEARCH + "q="), quote_plus(F.when(q == "", "news").otherwise(q)), locale.otherwise(F.concat(F.lit("&hl=en-US&gl="), c, F.lit("&ceid="), c, F.lit("%3Aen"))))


def topic_term(topic: Column, language: Column, terms: dict[tuple[str, str], str] | None = None) -> Column:
    """The localized word for a topic, from (language, topic) pairs; the topic's key where there is none."""
    out = reduce(lambda a, kv: a.when((language == kv[0][0]) & (topic == kv[0][1]), kv[1]), (terms or {}).items(), F.when(F.lit(False), ""))
    return out.otherwise(topic)


def fallback_urls(key: Column, name: Column, domain: Column, topic: Column, language: Column, country: Column, terms: dict[tuple[str, str], str] | None = None) -> Column:
    """Searches to try when a feed fails: the site with the topic, the site, the name, the key; each once, in this order."""
    term, who = topic_term(F.coalesce(F.nullif(topic, F.lit("")), F.lit("general")), language, terms), collapse(name)
    said = F.array(
        F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(" "), term)),
        F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(" news"))),
        F.when(who != "", F.concat(F.lit('"'), who, F.lit('" '), term)),
        F.replace(key, F.lit("_"), F.lit(" ")),
    )
    return F.array_distinct(F.transform(F.array_compact(said), lambda q: search_url(q, language, country)))


def topic_sources(seeds: DataFrame, topics: tuple[str, ...], terms: dict[tuple[str, str], str] | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """One search source for each language and topic, its seeds taking turns. ``seeds``: language, idx (from 0), name, domain, country."""
    n = seeds.groupBy("language").agg(F.count("*").alias("n"))
    wide = seeds.where(~F.col("language").isin(*disabled) if disabled else F.lit(True)).join(n, "language")
    wide = wide.select("*", F.posexplode(F.array(*[F.lit(t) for t in topics])).alias("place", "topic")).where("place % n = idx")
    query = F.concat(F.lit("site:"), F.col("domain"), F.lit(" "), topic_term(F.col("topic"), F.col("language"), terms))
    return wide.select("language", F.concat_ws("_", "language", slugify(F.col("name")), "topic", F.lit("gn")).alias("source_key"), "topic", F.col("domain").alias("site_domain"), search_url(query, F.col("language"), F.col("country")).alias("rss_url"), F.lit("google_news").alias("feed_source"))


def min_article_chars(base: Column, language: Column) -> Column:
    """Dense scripts need fewer characters."""
    return F.when(language.isin(*DENSE_LANGUAGES), F.greatest(F.lit(180), F.floor(base * 0.7))).otherwise(base).cast("int")


def source_language(key: Column, catalog: Column) -> Column:
    """The catalog's language, else the key's first part if that is one."""
    prefix = F.lower(F.substring_index(key, "_", 1))
    return F.coalesce(F.when(catalog.isin(*LOCALES), catalog), F.when(prefix.isin(*LOCALES), prefix), F.lit(""))


def infer_topic(key: Column, name: Column, url: Column, explicit: Column) -> Column:
    """C4: the given topic if it is one, else the first rung of the ladder whose stem stands as a word of its own."""
    told = F.lower(collapse(explicit))
    said = F.lower(F.concat_ws(" ", collapse(key), collapse(name), collapse(url)))
    out = F.when(told.isin(*TOPICS), told)
    for topic, words in TOPIC_LADDER:
        out = out.when(said.contains(topic) if words is None else said.rlike(f"{LEFT}(?:{words}){RIGHT}"), topic)
    return out.otherwise("general")


def infer_country(language: Column, key: Column, explicit: Column) -> Column:
    """The given country if it is known, else the source's, else the language's."""
    told = F.upper(collapse(explicit))
    by = reduce(lambda a, kv: a.when(key == kv[0], kv[1]), SOURCE_COUNTRY.items(), F.when(told.isin(*COUNTRIES), told))
    return reduce(lambda a, kv: a.when(language == kv[0], kv[1]), LANGUAGE_COUNTRY.items(), by).otherwise("US")


def infer_region(country: Column, explicit: Column) -> Column:
    """C5."""
    told = F.lower(collapse(explicit))
    by = reduce(lambda a, kv: a.when(country == kv[0], kv[1]), COUNTRIES.items(), F.when(told.isin(*REGIONS), told))
    return by.otherwise("global")


def site_key(domain: Column, url: Column) -> Column:
    """The given domain or the URL's authority, without www."""
    host = F.coalesce(F.nullif(F.lower(collapse(domain)), F.lit("")), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit(""))
    return F.regexp_replace(host, r"^www\d*\.", "")


def site_domain(domain: Column, url: Column) -> Column:
    """As C6, and a first label that only names the feed goes if two others stay; a given domain stays as it is."""
    host = F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(F.lower(url), F.lit("AUTHORITY"))), F.lit("")), r"^www\d*\.", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    cut = F.when((F.size(labels) >= 3) & F.get(labels, F.lit(0)).isin(*FEED_LABELS), F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")).otherwise(host)
    return F.coalesce(F.nullif(F.lower(collapse(domain)), F.lit("")), cut)


def topic_affinity(source: Column, target: Column) -> Column:
    """C8."""
    return F.when(source == target, 3).when(source == "general", 2).when(target == "general", 1).otherwise(0)


def best_of_site(sources: DataFrame) -> DataFrame:
    """For each site the source with a feed, then with a topic, then with the shorter key, then the earlier one.

    A site whose sources have several topics gets the topic general. ``sources``: pos, source_key, site, topic, has_feed.
    """
    order = Window.partitionBy("site").orderBy(F.col("has_feed").desc(), (F.col("topic") != "general").desc(), F.length("source_key"), "pos")
    topics = sources.groupBy("site").agg(F.countDistinct("topic").alias("topics"))
    best = sources.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return best.join(topics, "site").withColumn("topic", F.when(F.col("topics") > 1, "general").otherwise(F.col("topic"))).drop("topics")


def top_sources(sources: DataFrame, target: Column, per_topic: int = 3) -> DataFrame:
    """By affinity to the target topic, then a fixed rotation by hash (the order is deterministic here), three at most."""
    scored = sources.withColumn("affinity", topic_affinity(F.col("topic"), target)).withColumn("rotation", F.pmod(F.xxhash64("source_key", target), F.lit(997)))
    order = Window.partitionBy("language", "target").orderBy(F.col("affinity").desc(), "rotation", "source_key")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_topic)


def validate_sources(samples: DataFrame, min_chars: int, min_score: float) -> DataFrame:
    """Per source the ratios and means of its sampled articles, and pass with reasons and warnings."""
    good = (F.col("chars") >= min_chars) & (F.col("score") >= min_score)
    g = samples.groupBy("source_key").agg(F.count("*").alias("samples_tested"), F.count_if(good).alias("article_success_count"), F.avg(good.cast("double")).alias("article_success_ratio"), F.avg("chars").alias("avg_article_chars"), F.avg("score").alias("avg_quality_score"), F.avg(F.col("seed_ok").cast("double")).alias("summary_seed_success_ratio"))
    reasons = F.array_compact(F.array(F.when(F.col("article_success_ratio") < 0.5, "body_quality_low")))
    warnings = F.array_compact(F.array(F.when(F.col("summary_seed_success_ratio") < 0.5, "summary_seed_low")))
    return g.withColumns({"reasons": reasons, "warnings": warnings, "pass": F.size(reasons) == 0})


def with_feeds(validated: DataFrame, feeds: DataFrame) -> DataFrame:
    """A12 for all sources asked: ``feeds`` has source_key, entries and error (null, or the kind of error of its feed).

    A source whose feed failed or has no entries was not sampled: it has that reason alone, zeros, and doesn't pass.
    """
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("rss_exception:"), "error")).when(F.col("entries") == 0, "rss_no_entries")
    joined = feeds.join(validated, "source_key", "left").withColumn("failed", failed)
    zero = {c: F.when(F.col("failed").isNotNull(), 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("article_success_ratio", "avg_article_chars", "avg_quality_score", "summary_seed_success_ratio")}
    counts = {c: F.when(F.col("failed").isNotNull(), 0).otherwise(F.coalesce(c, F.lit(0))) for c in ("samples_tested", "article_success_count")}
    none = F.array().cast("array<string>")
    unsampled = F.array(F.lit("body_quality_low"))
    reasons = F.when(F.col("failed").isNotNull(), F.array("failed")).otherwise(F.coalesce("reasons", unsampled))
    warnings = F.when(F.col("failed").isNotNull(), none).otherwise(F.coalesce("warnings", F.array(F.lit("summary_seed_low"))))
    out = joined.withColumns(zero | counts | {"reasons": reasons, "warnings": warnings, "rss_ok": F.col("failed").isNull()})
    return out.withColumn("pass", F.col("rss_ok") & ~F.array_contains("reasons", "body_quality_low")).drop("failed", "error").withColumnRenamed("entries", "rss_entries")


# --- queries ---------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    words = F.element_at(F.array(*[F.lit(x) for x in ("Daily", "Sport", "World", "Tech", "Politic", "Culture")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("pos"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_key"), F.concat(F.lit("The "), words, F.lit(" "), F.col("n_name")).alias("name"),
        F.concat(F.lit("https://www"), F.when(F.col("s_suppkey") % 2 == 0, "2").otherwise(""), F.lit(".feeds.Site"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".example.org:80/a?b=1")).alias("rss_url"),
        F.when(F.col("s_suppkey") % 5 == 0, F.upper(F.left("r_name", F.lit(2)))).alias("country"), F.lower("r_name").alias("region"), F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("language"),
    )


SOURCES_SQL = """(SELECT s_suppkey AS pos, 's' || s_suppkey AS source_key, 'The ' || list_extract(['Daily','Sport','World','Tech','Politic','Culture'], CAST(s_suppkey % 6 + 1 AS INT)) || ' ' || n_name AS name,
 'https://www' || CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '' END || '.feeds.Site' || s_suppkey % 7 || '.example.org:80/a?b=1' AS rss_url, CASE WHEN s_suppkey % 5 = 0 THEN upper(left(r_name, 2)) END AS country,
 lower(r_name) AS region, list_extract(['en','fr','de','es'], CAST(s_suppkey % 4 + 1 AS INT)) AS language
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def c1_slugs(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_key", slugify(F.concat(F.lit("  "), F.col("name"), F.lit(" & Co. "))).alias("slug"))


def c2_search_urls(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_key", search_url(F.concat(F.col("name"), F.lit(" a&b")), F.col("language"), F.col("country")).alias("url"))


def c3_topic_sources(spark, sf_dir):
    s = _sources(spark, sf_dir)
    seeds = s.select("language", (F.row_number().over(Window.partitionBy("language").orderBy("pos")) - 1).alias("idx"), "name", F.lit("x.example").alias("domain"), "country")
    return topic_sources(seeds, TOPICS).select("language", "source_key", "topic")


def c10_fallback_urls(spark, sf_dir):
    s = _sources(spark, sf_dir)
    domain = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("site"), (F.col("pos") % 7).cast("string"), F.lit(".example.org"))).otherwise("")
    urls = fallback_urls(F.col("source_key"), F.col("name"), domain, F.lit(""), F.col("language"), F.col("country"))
    return s.select("source_key", F.size(urls).cast("long").alias("n"), F.get(urls, F.lit(0)).alias("first_url"))


def t26_source_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", source_language(F.concat(F.col("lang"), F.lit("_site")), F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("xx")).alias("language"))


def c4_topics(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_key", infer_topic(F.col("source_key"), F.col("name"), F.lit(""), F.lit("")).alias("topic"))


def c5_country_region(spark, sf_dir):
    s = _sources(spark, sf_dir).withColumn("c", infer_country(F.col("language"), F.col("source_key"), F.col("country")))
    return s.select("source_key", F.col("c").alias("country_key"), infer_region(F.col("c"), F.col("region")).alias("region_key"))


def c6_site_keys(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_key", site_key(F.lit(""), F.col("rss_url")).alias("site"), site_domain(F.lit(""), F.col("rss_url")).alias("domain"))


def _graded(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return s.select("pos", "source_key", "language", site_key(F.lit(""), F.col("rss_url")).alias("site"), infer_topic(F.col("source_key"), F.col("name"), F.lit(""), F.lit("")).alias("topic"), (F.col("pos") % 3 == 0).alias("has_feed"))


def c7_catalog(spark, sf_dir):
    gate = table(spark, sf_dir, "labels").where("quality = 0").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_key"))
    return best_of_site(_graded(spark, sf_dir).join(gate, "source_key", "left_anti")).select("site", "source_key", "topic", "has_feed")


def o12_best_of_site(spark, sf_dir):
    return best_of_site(_graded(spark, sf_dir)).select("site", "source_key", "topic")


def o13_top_sources(spark, sf_dir):
    targets = spark.createDataFrame([(t,) for t in TOPICS], "target string")
    # ten topics for each source: a product with a fixed-size dimension
    wide = _graded(spark, sf_dir).withColumn("target", F.explode(F.array(*[F.lit(t) for t in TOPICS]))).join(targets, "target")
    return top_sources(wide, F.col("target")).groupBy("language", "target").agg(F.count("*").alias("n"), F.max("affinity").cast("long").alias("best"))


def j2_source_lookup(spark, sf_dir):
    d, s = table(spark, sf_dir, "documents"), _graded(spark, sf_dir)
    key = F.concat(F.lit("s"), (F.col("doc_id") % 150).cast("string"))
    out = d.select("doc_id", key.alias("source_key")).join(s.select("source_key", "topic"), "source_key", "left")
    return out.select("doc_id", "source_key", F.coalesce("topic", F.lit("general")).alias("topic"))


def u1_source_union(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return s.where("pos % 2 = 0").select("source_key", "language").unionByName(s.where("pos % 3 = 0").select("language", "source_key")).groupBy("source_key").agg(F.count("*").alias("n"))


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_key"), (F.col("event_id") % 900).alias("chars"), F.col("value").alias("score"), (F.col("event_id") % 3 != 0).alias("seed_ok"))


def a12_source_validation(spark, sf_dir):
    v = validate_sources(_samples(spark, sf_dir), 400, 10.0)
    return v.select("source_key", "samples_tested", "article_success_count", F.round("article_success_ratio", 9).alias("ratio"), F.round("avg_article_chars", 6).alias("chars"), F.size("reasons").cast("long").alias("reasons"), F.size("warnings").cast("long").alias("warnings"), "pass")


def a13_validation_totals(spark, sf_dir):
    return validate_sources(_samples(spark, sf_dir), 400, 10.0).agg(F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"))


def a12_feeds_and_samples(spark, sf_dir):
    """Every fifth source's feed fails, every seventh is empty."""
    v = validate_sources(_samples(spark, sf_dir), 400, 10.0)
    user = F.substring("source_key", 2, 20).cast("long")
    feeds = v.select("source_key", F.when(user % 7 == 0, 0).otherwise(3).cast("long").alias("entries"), F.when(user % 5 == 0, "Timeout").alias("error"))
    return with_feeds(v, feeds).select("source_key", "rss_ok", "samples_tested", F.round("article_success_ratio", 9).alias("ratio"), F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "pass")


def o16_top_validated(spark, sf_dir):
    v = validate_sources(_samples(spark, sf_dir), 400, 10.0)
    return v.orderBy(F.col("pass").desc(), F.col("article_success_ratio").desc(), F.round("avg_quality_score", 9).desc(), F.col("avg_article_chars").desc(), "source_key").limit(25).select("source_key", "pass")


_NAMES = "c1_slugs c2_search_urls c3_topic_sources c10_fallback_urls t26_source_language c4_topics c5_country_region c6_site_keys c7_catalog o12_best_of_site o13_top_sources j2_source_lookup u1_source_union a12_source_validation a12_feeds_and_samples a13_validation_totals o16_top_validated"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_TOPIC = "CASE pos % 6 WHEN 1 THEN 'sports' WHEN 2 THEN 'world' WHEN 3 THEN 'technology' WHEN 4 THEN 'politics' WHEN 5 THEN 'culture' ELSE 'general' END"
_GRADED = f"g AS (SELECT pos, source_key, language, CASE WHEN TRUE THEN 'feeds.site' || pos % 7 || '.example.org:80' END AS site, {_TOPIC} AS topic, pos % 3 = 0 AS has_feed FROM {SOURCES_SQL})"
_BEST = "(SELECT *, count(DISTINCT topic) OVER (PARTITION BY site) AS topics, row_number() OVER (PARTITION BY site ORDER BY has_feed DESC, topic <> 'general' DESC, length(source_key), pos) AS n FROM {0})"
_VAL = "v AS (SELECT 'u' || user_id AS source_key, count(*) AS samples_tested, count(*) FILTER (event_id % 900 >= 400 AND value >= 10) AS ok, avg(event_id % 900) AS chars, avg(value) AS score, avg(CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) AS seed FROM events GROUP BY user_id)"

_LOCALE_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN '&hl={a}&gl={b}&ceid={c.replace(':', '%3A')}'" for k, (a, b, c) in LOCALES.items()) + " END"

ORACLE = {
    "c1_slugs": f"SELECT source_key, trim(regexp_replace(lower(name || ' & Co.'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM {SOURCES_SQL}",
    "c2_search_urls": f"SELECT source_key, 'https://news.google.com/rss/search?q=' || replace(name, ' ', '+') || '+a%26b' || {_LOCALE_SQL} AS url FROM {SOURCES_SQL}",
    "c3_topic_sources": f"WITH s AS (SELECT language, row_number() OVER (PARTITION BY language ORDER BY pos) - 1 AS idx, name, count(*) OVER (PARTITION BY language) AS n FROM {SOURCES_SQL}), t AS (SELECT unnest([{', '.join(repr(t) for t in TOPICS)}]) AS topic, unnest(range({len(TOPICS)})) AS place) SELECT language, language || '_' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || topic || '_gn' AS source_key, topic FROM s, t WHERE place % n = idx",
    "c10_fallback_urls": f"SELECT source_key, CASE WHEN pos % 2 = 0 THEN 4 ELSE 2 END AS n, 'https://news.google.com/rss/search?q=' || CASE WHEN pos % 2 = 0 THEN 'site%3Asite' || pos % 7 || '.example.org+general' ELSE '%22' || replace(name, ' ', '+') || '%22+general' END || {_LOCALE_SQL} AS first_url FROM {SOURCES_SQL}",
    "t26_source_language": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fr' WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE '' END AS language FROM documents",
    "c4_topics": f"SELECT source_key, {_TOPIC} AS topic FROM {SOURCES_SQL}",
    "c5_country_region": "WITH s AS (SELECT source_key, region, CASE WHEN country IN (" + ", ".join(f"'{c}'" for c in COUNTRIES) + f") THEN country WHEN language = 'fr' THEN 'FR' WHEN language = 'de' THEN 'DE' WHEN language = 'es' THEN 'ES' ELSE 'US' END AS country_key FROM {SOURCES_SQL}) SELECT source_key, country_key, CASE WHEN region IN (" + ", ".join(f"'{r}'" for r in REGIONS) + ") THEN region " + " ".join(f"WHEN country_key = '{c}' THEN '{r}'" for c, r in COUNTRIES.items()) + " ELSE 'global' END AS region_key FROM s",
    "c6_site_keys": f"SELECT source_key, 'feeds.site' || pos % 7 || '.example.org:80' AS site, 'site' || pos % 7 || '.example.org:80' AS domain FROM {SOURCES_SQL}",
    "c7_catalog": f"WITH {_GRADED}, k AS (SELECT * FROM g WHERE source_key NOT IN (SELECT 's' || doc_id FROM labels WHERE quality = 0)) SELECT site, source_key, CASE WHEN topics > 1 THEN 'general' ELSE topic END AS topic, has_feed FROM {_BEST.format('k')} WHERE n = 1",
    "o12_best_of_site": f"WITH {_GRADED} SELECT site, source_key, CASE WHEN topics > 1 THEN 'general' ELSE topic END AS topic FROM {_BEST.format('g')} WHERE n = 1",
    "o13_top_sources": f"WITH {_GRADED}, w AS (SELECT language, target, CASE WHEN topic = target THEN 3 WHEN topic = 'general' THEN 2 WHEN target = 'general' THEN 1 ELSE 0 END AS a FROM g, (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS target)) SELECT language, target, least(3, count(*)) AS n, CAST(max(a) AS BIGINT) AS best FROM w GROUP BY language, target",
    "j2_source_lookup": f"WITH {_GRADED} SELECT d.doc_id, 's' || d.doc_id % 150 AS source_key, coalesce(g.topic, 'general') AS topic FROM documents d LEFT JOIN g ON g.source_key = 's' || d.doc_id % 150",
    "u1_source_union": f"SELECT source_key, count(*) AS n FROM (SELECT source_key FROM {SOURCES_SQL} WHERE pos % 2 = 0 UNION ALL SELECT source_key FROM {SOURCES_SQL} WHERE pos % 3 = 0) GROUP BY source_key",
    "a12_source_validation": f"WITH {_VAL} SELECT source_key, samples_tested, ok AS article_success_count, round(ok / samples_tested, 9) AS ratio, round(chars, 6) AS chars, CASE WHEN ok / samples_tested < 0.5 THEN 1 ELSE 0 END AS reasons, CASE WHEN seed < 0.5 THEN 1 ELSE 0 END AS warnings, ok / samples_tested >= 0.5 AS pass FROM v",
    "a12_feeds_and_samples": f"WITH {_VAL}, w AS (SELECT *, CAST(substr(source_key, 2) AS BIGINT) AS u FROM v), x AS (SELECT *, CASE WHEN u % 5 = 0 THEN 'rss_exception:Timeout' WHEN u % 7 = 0 THEN 'rss_no_entries' END AS failed FROM w) SELECT source_key, failed IS NULL AS rss_ok, CASE WHEN failed IS NULL THEN samples_tested ELSE 0 END AS samples_tested, CASE WHEN failed IS NULL THEN round(ok / samples_tested, 9) ELSE 0.0 END AS ratio, coalesce(failed, CASE WHEN ok / samples_tested < 0.5 THEN 'body_quality_low' ELSE '' END) AS reasons, CASE WHEN failed IS NULL AND seed < 0.5 THEN 'summary_seed_low' ELSE '' END AS warnings, failed IS NULL AND ok / samples_tested >= 0.5 AS pass FROM x",
    "a13_validation_totals": f"WITH {_VAL} SELECT count(*) FILTER (ok / samples_tested >= 0.5) AS passed, count(*) FILTER (ok / samples_tested < 0.5) AS failed FROM v",
    "o16_top_validated": f"WITH {_VAL} SELECT source_key, ok / samples_tested >= 0.5 AS pass FROM v ORDER BY pass DESC, ok / samples_tested DESC, round(score, 9) DESC, chars DESC, source_key LIMIT 25",
}

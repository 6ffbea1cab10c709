"""Queries over article cleaning, scoring and extractive summaries, and over summary caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import article as ar
from newsloom.functions import html
from newsloom.functions import text as tx
from newsloom.plans.corpus import clean_sql
from newsloom.plans.evaluation import collapse_sql
from newsloom.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.clean(F.col("text")).alias("text"))


def t13_dedupe_segments(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.dedupe_segments(tx.sentences(F.col("text"))).alias("kept"))


def t15_metadata_sentences(spark, sf_dir):
    """Which sentences are notes: their places and texts."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "s"))
    return s.where(tx.metadata_sentence(F.col("s"), "en") | (F.col("s") == "")).select("doc_id", F.col("i").cast("long").alias("i"), F.col("s").alias("sentence"))


def t17_source_cleanup(spark, sf_dir):
    d = _docs(spark, sf_dir)
    made = F.concat(F.lit("Read more "), "text", F.lit(" listen to this article"))
    url = F.when(F.col("doc_id") % 2 == 0, "https://www.bbc.com/x").otherwise("https://x.example/")
    return d.select("doc_id", ar.source_cleanup(made, F.col("source"), url).alias("text"))


def t18_filter_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ar.filter_noise(F.col("text")).alias("text"))


def t19_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(ar.score(F.col("text")), 6).alias("score"))


def t20_pick_best(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", ar.pick_best(F.array(F.left(t, F.lit(300)), t, F.lit(""))).alias("text"))


def e8_article_text(spark, sf_dir):
    return html.with_article(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "text").select("page_id", "text")


def t4_repaired(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = tx.repair_mojibake(broken)
    return d.select("doc_id", (fixed == F.col("text")).alias("repaired"))


def t16_prefixes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.strip_prefix(F.concat(F.when(F.col("doc_id") % 2 == 0, "Last updated: 12.01.2024 10:30 | ").otherwise(""), "text")).alias("text"))


def t21_clean_for_summary(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", ar.clean_for_summary(F.col("text"), F.col("lang"), F.left("text", F.lit(60)), F.col("source"), F.lit("")).alias("text"))


def t23_postprocessed(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", ar.postprocess(F.left("text", F.lit(200)), F.left("text", F.lit(40)), F.col("lang")).alias("summary"))


def t24_decoded(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.decode_html(F.encode("html", "UTF-8"), F.lit("text/html; charset=utf-8"), F.lit("en")).alias("html"))


def g1_extractive(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.extractive(F.col("text"), 280).alias("summary"))


def g2_degenerate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.degenerate(F.col("text")).alias("degenerate"))


def g3_finalized(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.finalize(F.left("text", F.lit(150)), F.col("text")).alias("summary"))


def g6_summaries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ar.summarize(F.col("text"), F.left("text", F.lit(60))).alias("summary"))


def g5_summary_cache(spark, sf_dir):
    """One computation for each (language, text): the key is a hash of the text, so a changed text is never served stale."""
    d = _docs(spark, sf_dir).withColumn("key", F.sha2("text", 256))
    made = d.dropDuplicates(["lang", "key"]).select("lang", "key", ar.cut_at_space(F.concat(F.col("text"), F.lit(" ")), 40).alias("summary"))
    return d.join(made, ["lang", "key"]).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("key").alias("texts"))


def g5_cached_summaries(spark, sf_dir):
    """G5 with what it keeps: each (language, text) is summarised once and the summary goes to every document that has it."""
    d = _docs(spark, sf_dir).withColumn("key", F.sha2("text", 256))
    made = d.groupBy("lang", "key").agg(F.first("text").alias("t")).select("lang", "key", ar.summarize(F.col("t"), F.lit("")).alias("summary"))
    return d.select("doc_id", "lang", "key").join(made, ["lang", "key"]).select("doc_id", "summary")


_NAMES = "g5_cached_summaries t4_repaired t16_prefixes t21_clean_for_summary t23_postprocessed t24_decoded t13_dedupe_segments t15_metadata_sentences t17_source_cleanup t18_filter_noise t19_score t20_pick_best e8_article_text g1_extractive g2_degenerate g3_finalized g6_summaries g5_summary_cache"
QUERIES = {n: globals()[n] for n in _NAMES.split()}
ORACLE = {
    "t16_prefixes": f"SELECT doc_id, trim(regexp_replace({clean_sql('text')}, '^(?i)' || '(giriş( tarihi)?|yayınlanma tarihi|yayinlanma tarihi|son güncelleme|son guncelleme|güncelleme tarihi|guncelleme tarihi|updated|last updated|published)\\s*[:-]\\s*', '')) AS text FROM documents",
    "g5_summary_cache": f"SELECT lang, count(*) AS n, count(DISTINCT {collapse_sql('text')}) AS texts FROM documents GROUP BY lang",
    "g2_degenerate": rf"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({collapse_sql('text')}), '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT doc_id, sum(n) AS n, count(*) AS different, max(n) AS most FROM c GROUP BY doc_id) SELECT doc_id, coalesce(n >= 8 AND (different < 0.38 * n OR most > greatest(6, floor(n / 3))), FALSE) AS degenerate FROM documents LEFT JOIN m USING (doc_id)",
}

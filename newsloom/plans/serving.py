"""The serving feed: filter, join, newest first, pre-limit, cap for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.plans import fixtures as fx

PRE_LIMIT, PER_SOURCE = 300, 5


def serve(items: DataFrame, summaries: DataFrame, model: str, language: str, limit: int = PRE_LIMIT, per_source: int = PER_SOURCE) -> DataFrame:
    """F4 + J1 + O1 + O3. The cap comes after the pre-limit, empty summaries neither shown nor counted."""
    joined = (
        items.where(F.col("language_key") == language)
        .alias("i")
        .join(summaries.where((F.col("model_key") == model) & (F.col("language_key") == language)).alias("s"), F.expr("i.id = s.news_item_id"))
        .select("i.id", "i.link", "i.source_key", "i.title", "s.summary", F.coalesce("i.published_at", "i.fetched_at").alias("shown_at"))
    )
    newest = [F.col("shown_at").desc(), F.col("id")]
    first = joined.orderBy(*newest).limit(limit).where(F.col("summary") != "")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("source_key").orderBy(*newest))).where(F.col("rank") <= per_source)


def serving_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve(fx.news_items(spark, sf_dir), fx.news_summaries(spark, sf_dir), "model_a", "en")


QUERIES = {"serving_feed": serving_feed}
ORACLE = {
    "serving_feed": f"""
WITH j AS (SELECT i.id, i.link, i.source_key, i.title, s.summary, coalesce(i.published_at, i.fetched_at) AS shown_at
  FROM {fx.NEWS_ITEMS_SQL} i JOIN {fx.NEWS_SUMMARIES_SQL} s ON i.id = s.news_item_id
  WHERE i.language_key = 'en' AND s.language_key = 'en' AND s.model_key = 'model_a'
  ORDER BY shown_at DESC, id LIMIT {PRE_LIMIT})
SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY shown_at DESC, id)::INT AS rank FROM j WHERE summary <> ''
QUALIFY rank <= {PER_SOURCE}""",
}

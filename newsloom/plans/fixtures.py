"""Views of the test tables in the shape of the engine's own tables (items, summaries, runs, sources).

The Spark side and the SQL side are written side by side so that both read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import table

#: Topic keys in order.
TOPICS = ("general", "politics", "economy", "technology", "science", "health", "sports", "culture", "world", "environment")
#: Default country and region by language.
COUNTRY = {"en": "US", "fr": "FR", "de": "DE", "es": "ES"}
REGION = {"US": "americas", "FR": "europe", "DE": "europe", "ES": "europe"}
EPOCH = 1704067200
MODELS = ("model_a", "model_b")


def _case(column: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    topics = F.array(*[F.lit(t) for t in TOPICS])
    country = F.expr(_case("lang", COUNTRY, ""))
    iso = lambda step: F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * step), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("link"),
        F.col("source").alias("source_key"),
        F.upper("source").alias("source_name"),
        F.col("lang").alias("language_key"),
        F.get(topics, (F.col("doc_id") % 10).cast("int")).alias("topic_key"),
        country.alias("country_key"),
        F.expr(_case(f"({_case('lang', COUNTRY, '')})", REGION, "global")).alias("region_key"),
        F.left("text", F.lit(60)).alias("title"),
        F.when(F.col("doc_id") % 10 != 0, iso(60)).alias("published_at"),
        F.lit("").alias("image_url"),
        F.col("text").alias("article_text"),
        iso(61).alias("fetched_at"),
        iso(61).alias("updated_at"),
    )


def _iso_sql(step: int) -> str:
    return f"strftime(make_timestamp(({EPOCH} + {step} * doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


NEWS_ITEMS_SQL = f"""(
  SELECT doc_id AS id, 'doc:' || CAST(doc_id AS VARCHAR) AS link, source AS source_key, upper(source) AS source_name,
         lang AS language_key, list_extract([{', '.join(f"'{t}'" for t in TOPICS)}], CAST(doc_id % 10 AS INT) + 1) AS topic_key,
         {_case('lang', COUNTRY, '')} AS country_key, {_case('(' + _case('lang', COUNTRY, '') + ')', REGION, 'global')} AS region_key,
         left(text, 60) AS title, CASE WHEN doc_id % 10 <> 0 THEN {_iso_sql(60)} END AS published_at, '' AS image_url,
         text AS article_text, {_iso_sql(61)} AS fetched_at, {_iso_sql(61)} AS updated_at
  FROM documents)"""


def news_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    size = {"model_a": 280, "model_b": 120}
    parts = [
        d.select(
            (F.col("doc_id") * 2 + i).alias("id"),
            F.col("doc_id").alias("news_item_id"),
            F.lit(m).alias("model_key"),
            F.col("lang").alias("language_key"),
            F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.left("text", F.lit(size[m]))).alias("summary"),
        )
        for i, m in enumerate(MODELS)
    ]
    return parts[0].unionByName(parts[1])


NEWS_SUMMARIES_SQL = (
    "("
    + " UNION ALL ".join(
        f"SELECT doc_id * 2 + {i} AS id, doc_id AS news_item_id, '{m}' AS model_key, lang AS language_key, "
        f"CASE WHEN doc_id % 7 = 0 THEN '' ELSE left(text, {n}) END AS summary FROM documents"
        for i, (m, n) in enumerate((("model_a", 280), ("model_b", 120)))
    )
    + ")"
)

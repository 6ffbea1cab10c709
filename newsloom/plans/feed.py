
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.plans import fixtures as fx
from newsloom.session import table

NO_FILTER = ("", "all", "__all__")


# --- operators ------------------------------------------------------------------------------------


def normalize_filter(value: Column) -> Column:
    """trimmed, lower case, and '' for every spelling of "no filter"."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\p{Z}]+", " ")))
    return F.when(text.isin(*NO_FILTER), F.lit("")).otherwise(F.trim(F.coalesce(value, F.lit(""))))


def filter_sources(sources: DataFrame, language: str, topic: str = "", country: str = "", region: str = "") -> DataFrame:
    """the language must match; the other three restrict only where they are given."""
    asked = {"topic": topic.lower(), "country": country.upper(), "region": region.lower()}
    tests = [F.col("language") == language] + [F.col(k) == v for k, v in asked.items() if v.lower() not in NO_FILTER]
    return sources.where(reduce(lambda a, b: a & b, tests))


def filter_items(items: DataFrame, equal: dict[str, str], sources: list[str] | None = None) -> DataFrame:
    """a conjunction of equalities, and membership for source keys."""
    tests = [F.col(k) == v for k, v in equal.items() if v] + ([F.col("source_key").isin(sources)] if sources else [])
    return items.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def like_ascii(column: str, keyword: str) -> Column:
    """LIKE '%keyword%' that ignores the case of A-Z only; % and _ of the keyword stay wildcards."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "%" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in keyword) + "%"
    return fold(F.col(column)).like(pattern.replace("\\", "\\\\"))


def keyword_required(keyword: str) -> str:
    """one word, not empty."""
    word = keyword.strip()
    if not word or any(c.isspace() for c in word):
        raise ValueError("the keyword must be a single word")
    return word


def date_range(rows: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """rows without a date stay."""
    tests = ([F.col(column) >= F.lit(since).cast("timestamp")] if since else []) + ([F.col(column) <= F.lit(until).cast("timestamp")] if until else [])
    return rows.where(F.col(column).isNull() | reduce(lambda a, b: a & b, tests, F.lit(True)))


def parse_iso(text: Column) -> Column:
    """F8: ISO date-time, Z allowed, no zone means UTC; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def parse_rfc822(text: Column) -> Column:
    """RFC-822 date; the day name is dropped first, as Spark can't parse it."""
    bare = F.regexp_replace(F.trim(text), r"^\p{L}+,\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))


def pre_limit(selected: int, catalog: int, per_source: int) -> int:
    """O2: rows to read before the cap for each source."""
    return max(20, min(1000, (selected or max(1, catalog)) * per_source * 6))


def round_robin(rows: DataFrame, source: str, position: str) -> DataFrame:
    """The first row of each source in first-seen order, then the second ones, and so on; column turn_order from 1: the rows of the turns before and the place within the turn."""
    own = Window.partitionBy(source)
    ranked = rows.withColumn("turn", F.row_number().over(own.orderBy(position))).withColumn("first_seen", F.min(position).over(own))
    turns = ranked.groupBy("turn").count()
    before = turns.select("turn", (F.sum("count").over(Window.orderBy("turn")) - F.col("count")).alias("before"))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy("first_seen")))
    return placed.join(before, "turn").withColumn("turn_order", F.col("before") + F.col("place")).drop("before", "place")


def language_budgets(languages: DataFrame, budget: int) -> DataFrame:
    """An even split, the remainder to the first ones. ``languages``: language, idx (from 0)."""
    n = languages.count()
    return languages.withColumn("budget", (F.lit(budget // max(1, n)) + F.when(F.col("idx") < budget % max(1, n), 1).otherwise(0)).cast("long"))


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """K1: by link; new values win, but an empty image or text and a missing date keep the old ones. Adds inserted."""
    keep_old = {"published_at": lambda n, o: F.coalesce(n, o), "image_url": lambda n, o: F.coalesce(F.nullif(n, F.lit("")), o, n), "article_text": lambda n, o: F.coalesce(F.nullif(n, F.lit("")), o, n)}
    joined = old.alias("o").join(new.alias("n"), "link", "full_outer")
    columns = []
    for c in old.columns:
        if c == "link":
            columns.append(F.col("link"))
        else:
            n, o = F.col(f"n.{c}"), F.col(f"o.{c}")
            value = keep_old[c](n, o) if c in keep_old else n
            columns.append(F.when(F.col("n.id").isNull(), o).otherwise(F.coalesce(o, n) if c == "id" else value).alias(c))
    return joined.select(*columns, (F.col("o.id").isNull()).alias("inserted"))


def upsert_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """K2: by (item, model, language); the first created_at stays, the last text and updated_at win."""
    key = ["news_item_id", "model_key", "language_key"]
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)))
    newest = F.struct("__b", "updated_at", "summary")
    return both.groupBy(*key).agg(F.max(newest)["summary"].alias("summary"), F.min("created_at").alias("created_at"), F.max(newest)["updated_at"].alias("updated_at"))


def admit(entries: DataFrame, per_source: int, budgets: DataFrame) -> DataFrame:
    """The admission loop of one run, language by language, in order of position.

    ``entries``: language, source_key, pos, in_range, success; ``budgets``: language, budget. Adds decision: one of
    over_budget, source_cap, out_of_range, failed, admitted. A source's count rises with its successes only, so the
    loop is sequential within a language; a language's rows stream through in sorted order, holding counters alone.
    """
    from collections import Counter

    import pandas as pd

    joined = entries.join(budgets, "language", "left")

    def run(frames):
        language, left, done = None, 0, Counter()
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                if row.language != language:
                    language, left, done = row.language, int(row.budget) if row.budget == row.budget and row.budget is not None else 0, Counter()
                if left <= 0:
                    out.append("over_budget")
                elif done[row.source_key] >= per_source:
                    out.append("source_cap")
                elif not row.in_range:
                    out.append("out_of_range")
                else:
                    left -= 1
                    done[row.source_key] += bool(row.success)
                    out.append("admitted" if row.success else "failed")
            yield pd.DataFrame({"language": pdf["language"], "source_key": pdf["source_key"], "pos": pdf["pos"], "decision": out})

    sorted_ = joined.select("language", "source_key", "pos", "in_range", "success", "budget").repartition("language").sortWithinPartitions("language", "pos")
    return sorted_.mapInPandas(run, "language string, source_key string, pos long, decision string")


# --- queries -----------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_key"), F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("user_id") % 4 + 1).cast("int")).alias("language"), F.col("ts").cast("timestamp").alias("published_at"), (F.col("value") >= 10).alias("success"), "event_type", "value")


EVENTS_SQL = "(SELECT event_id, 'u' || user_id AS source_key, list_extract(['en','fr','de','es'], CAST(user_id % 4 + 1 AS INT)) AS language, ts AS published_at, value >= 10 AS success, event_type, value FROM events)"
I, S = fx.NEWS_ITEMS_SQL, fx.NEWS_SUMMARIES_SQL


def f1_filter_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.element_at(F.array(*[F.lit(x) for x in (" All ", "__ALL__", "", "Sports ", "all")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", normalize_filter(raw).alias("value"))


def f4_items_filtered(spark, sf_dir):
    return filter_items(fx.news_items(spark, sf_dir), {"language_key": "en", "topic_key": "science"}, ["src1", "src4", "src8", "src14"]).select("id", "link", "topic_key", "source_key")


def f5_keyword(spark, sf_dir):
    i, s = fx.news_items(spark, sf_dir), fx.news_summaries(spark, sf_dir).where("model_key = 'model_a'")
    hit = like_ascii("title", "THERE") | like_ascii("summary", "THERE") | like_ascii("article_text", "THERE")
    return i.join(s.select("news_item_id", "summary"), F.col("id") == F.col("news_item_id")).where(hit).select("id", "source_key")


def f7_date_range(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("published_at", F.when(F.col("event_id") % 10 != 0, F.col("published_at")))
    return date_range(e, "published_at", "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("event_id", "source_key")


def f10_article_rows(spark, sf_dir):
    i = fx.news_items(spark, sf_dir)
    return i.select("id", "title", "link", F.coalesce("published_at", "fetched_at").alias("published"), F.when(F.col("id") % 2 == 0, F.col("article_text")).alias("raw"))


def f13_training_rows(spark, sf_dir):
    s = fx.news_summaries(spark, sf_dir)
    return s.where(F.trim(F.coalesce("summary", F.lit(""))) != "").groupBy("model_key", "language_key").agg(F.count("*").alias("n"))


def f14_reuters_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    quality = F.when(F.col("quality") == 0, "LOW").when(F.col("quality") == 1, "high")
    return d.where((n > 30) & (n < 800) & ~F.lower(quality).eqNullSafe(F.lit("low"))).select("doc_id", n.cast("long").alias("n_words"))


def j1_items_with_summary(spark, sf_dir):
    i, s = fx.news_items(spark, sf_dir), fx.news_summaries(spark, sf_dir)
    return i.join(s.where("model_key = 'model_b'"), i.id == s.news_item_id).select(i.id, i.source_key, s.model_key, F.length("summary").cast("long").alias("summary_chars"))


def j6_gated_anti(spark, sf_dir):
    gate = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(gate, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def k1_upsert_items(spark, sf_dir):
    i = fx.news_items(spark, sf_dir).select("id", "link", "title", "published_at", "image_url", "article_text", "fetched_at")
    old = i.where("id % 3 <> 2").withColumn("image_url", F.concat(F.lit("img"), F.col("id").cast("string")))
    new = i.where("id % 3 <> 0").withColumn("title", F.concat(F.lit("new "), F.col("title"))).withColumn("article_text", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("article_text"))).withColumn("published_at", F.lit(None).cast("string"))
    return upsert_items(old, new).select("id", "link", "title", "published_at", "image_url", F.length("article_text").cast("long").alias("text_chars"), "inserted")


def k2_upsert_summaries(spark, sf_dir):
    s = fx.news_summaries(spark, sf_dir)
    at = lambda t: [F.lit(t).alias("created_at"), F.lit(t).alias("updated_at")]
    key = ["news_item_id", "model_key", "language_key"]
    old = s.where("news_item_id % 3 <> 2").select(*key, "summary", *at("2024-01-01T00:00:00+00:00"))
    new = s.where("news_item_id % 3 <> 0").select(*key, F.left("summary", F.lit(20)).alias("summary"), *at("2024-02-01T00:00:00+00:00"))
    return upsert_summaries(old, new)


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), status.alias("status"), F.to_json(F.struct(F.col("o_totalprice").cast("long").alias("processed"))).alias("stats_json"))


RUNS_SQL = "(SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS started_at, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(trunc(o_totalprice) AS BIGINT) AS processed FROM orders)"


def k3_run_log(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("processed", F.from_json("stats_json", "processed long")["processed"])
    return r.groupBy("status").agg(F.count("*").alias("runs"), F.sum("processed").alias("processed"))


def o15_latest_run(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", "started_at", "status").orderBy(F.col("id").desc()).limit(1)


def o4_round_robin(spark, sf_dir):
    return round_robin(_events(spark, sf_dir), "source_key", "event_id").select("event_id", "source_key", F.col("turn_order").cast("long"))


def o5_language_budgets(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").groupBy("lang").count().select(F.col("lang").alias("language"), (F.row_number().over(Window.orderBy("lang")) - 1).alias("idx"))
    return language_budgets(langs, 203).select("language", "budget")


def o6_admission(spark, sf_dir):
    e = _events(spark, sf_dir).select("language", "source_key", F.col("event_id").alias("pos"), F.col("published_at").between(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-28").cast("timestamp")).alias("in_range"), "success")
    langs = spark.createDataFrame([(k, i) for i, k in enumerate(("en", "fr", "de", "es"))], "language string, idx int")
    return admit(e, 2, language_budgets(langs, 200).select("language", "budget"))


def s9_gather(spark, sf_dir):
    e = _events(spark, sf_dir).where("language = 'en'")
    newest = [F.col("published_at").desc_nulls_last(), F.col("event_id")]
    top = e.withColumn("rn", F.row_number().over(Window.partitionBy("source_key").orderBy(*newest))).where("rn <= 3")
    return top.orderBy(*newest).limit(50).select("event_id", "source_key", F.col("rn").cast("long"))


def a14_ingest_stats(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("language").agg(F.count("*").alias("processed"), F.count_if("success").alias("saved"), F.count_if(~F.col("success")).alias("skipped"), F.count_if(F.col("event_type") == "click").alias("clicks"))


QUERIES = {f.__name__: f for f in (f1_filter_values, f4_items_filtered, f5_keyword, f7_date_range, f10_article_rows, f13_training_rows, f14_reuters_filter, j1_items_with_summary, j6_gated_anti, k1_upsert_items, k2_upsert_summaries, k3_run_log, o15_latest_run, o4_round_robin, o5_language_budgets, o6_admission, s9_gather, a14_ingest_stats)}

ORACLE = {
    "f1_filter_values": "SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'Sports' ELSE '' END AS value FROM documents",
    "f4_items_filtered": f"SELECT id, link, topic_key, source_key FROM {I} WHERE language_key = 'en' AND topic_key = 'science' AND source_key IN ('src1','src4','src8','src14')",
    "f5_keyword": f"SELECT i.id, i.source_key FROM {I} i JOIN {S} s ON i.id = s.news_item_id WHERE s.model_key = 'model_a' AND (" + " OR ".join(f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%there%'" for c in ("title", "summary", "article_text")) + ")",
    "f7_date_range": f"SELECT event_id, source_key FROM {EVENTS_SQL} WHERE event_id % 10 = 0 OR published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "f10_article_rows": f"SELECT id, title, link, coalesce(published_at, fetched_at) AS published, CASE WHEN id % 2 = 0 THEN article_text END AS raw FROM {I}",
    "f13_training_rows": f"SELECT model_key, language_key, count(*) AS n FROM {S} WHERE trim(summary) <> '' GROUP BY ALL",
    "f14_reuters_filter": "SELECT d.doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\x0b]+')) AS BIGINT) AS n_words FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_words > 30 AND n_words < 800 AND (quality IS NULL OR quality <> 0)",
    "j1_items_with_summary": f"SELECT i.id, i.source_key, s.model_key, length(summary) AS summary_chars FROM {I} i JOIN {S} s ON i.id = s.news_item_id WHERE s.model_key = 'model_b'",
    "j6_gated_anti": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY source",
    "k1_upsert_items": f"""WITH i AS (SELECT * FROM {I}),
 o AS (SELECT *, 'img' || id AS img FROM i WHERE id % 3 <> 2),
 n AS (SELECT id, link, 'new ' || title AS title, CASE WHEN id % 2 = 0 THEN '' ELSE article_text END AS article_text FROM i WHERE id % 3 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.link, n.link) AS link, coalesce(n.title, o.title) AS title, o.published_at, coalesce(o.img, '') AS image_url,
 length(CASE WHEN n.id IS NULL THEN o.article_text ELSE coalesce(nullif(n.article_text, ''), o.article_text, n.article_text) END) AS text_chars, o.id IS NULL AS inserted
FROM o FULL JOIN n ON o.link = n.link""",
    "k2_upsert_summaries": f"""WITH s AS (SELECT * FROM {S}), o AS (SELECT * FROM s WHERE news_item_id % 3 <> 2), n AS (SELECT * FROM s WHERE news_item_id % 3 <> 0)
SELECT coalesce(o.news_item_id, n.news_item_id) AS news_item_id, coalesce(o.model_key, n.model_key) AS model_key, coalesce(o.language_key, n.language_key) AS language_key,
 coalesce(left(n.summary, 20), o.summary) AS summary, CASE WHEN o.id IS NULL THEN '2024-02-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS created_at,
 CASE WHEN n.id IS NULL THEN '2024-01-01T00:00:00+00:00' ELSE '2024-02-01T00:00:00+00:00' END AS updated_at
FROM o FULL JOIN n ON o.news_item_id = n.news_item_id AND o.model_key = n.model_key AND o.language_key = n.language_key""",
    "k3_run_log": f"SELECT status, count(*) AS runs, CAST(sum(processed) AS BIGINT) AS processed FROM {RUNS_SQL} GROUP BY status",
    "o15_latest_run": f"SELECT id, started_at, status FROM {RUNS_SQL} ORDER BY id DESC LIMIT 1",
    "o4_round_robin": f"WITH e AS (SELECT * FROM {EVENTS_SQL}), r AS (SELECT event_id, source_key, row_number() OVER (PARTITION BY source_key ORDER BY event_id) AS turn, min(event_id) OVER (PARTITION BY source_key) AS fs FROM e) SELECT event_id, source_key, row_number() OVER (ORDER BY turn, fs) AS turn_order FROM r",
    "o5_language_budgets": "WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)) SELECT lang AS language, CAST(203 // n + CASE WHEN idx < 203 % n THEN 1 ELSE 0 END AS BIGINT) AS budget FROM l",
    "s9_gather": f"WITH r AS (SELECT event_id, source_key, published_at, row_number() OVER (PARTITION BY source_key ORDER BY published_at DESC, event_id) AS rn FROM {EVENTS_SQL} WHERE language = 'en') SELECT event_id, source_key, rn FROM r WHERE rn <= 3 ORDER BY published_at DESC, event_id LIMIT 50",
    "a14_ingest_stats": f"SELECT language, count(*) AS processed, count(*) FILTER (success) AS saved, count(*) FILTER (NOT success) AS skipped, count(*) FILTER (event_type = 'click') AS clicks FROM {EVENTS_SQL} GROUP BY language",
}

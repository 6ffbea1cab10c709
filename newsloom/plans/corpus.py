"""Corpus statistics and training-set preparation, and relational uses of the text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.ranks import percentiles
from newsloom.plans.evaluation import SPACE_SQL, collapse_sql
from newsloom.session import table
from newsloom.storage import Stored

CJK_SQL = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"
CJK_WIDE_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
PERCENTS = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))
SPLIT_SQL = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def describe(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A4: nine numbers of each column; the deviation of a single row is 0; percentiles are interpolated exactly."""
    kept = Stored(rows.select(*keys, *columns)).df
    plain = []
    for c in columns:
        plain += [F.avg(c).alias(f"{c}_mean"), F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c)).alias(f"{c}_std"), F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    values = kept.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.*")
    found = percentiles(values, [*keys, "name"], "value", dict(PERCENTS))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n, _ in PERCENTS]).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return kept.groupBy(*keys).agg(*plain).join(wide, same, "left").drop(*[f"__{k}" for k in keys])


def describe_sql(c: str) -> str:
    return f"avg({c}) AS {c}_mean, CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END AS {c}_std, CAST(min({c}) AS DOUBLE) AS {c}_min, " + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for n, q in PERCENTS) + f", CAST(max({c}) AS DOUBLE) AS {c}_max"


def overlap_tokens(text: Column) -> Column:
    """D3: all words first, then all CJK characters."""
    t = F.lower(tx.collapse(text))
    return F.concat(F.regexp_extract_all(F.regexp_replace(t, tx.CJK_WIDE, " "), F.lit(f"({tx.WORD}+)"), F.lit(1)), F.regexp_extract_all(t, F.lit(f"({tx.CJK_WIDE})"), F.lit(1)))


def gram_set(tokens: Column, n: int) -> Column:
    """D4."""
    from newsloom.functions.metrics import ngrams

    return F.array_distinct(ngrams(tokens, n))


def alpha_targets(rows: DataFrame, key: str, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """Targets proportional to count ** alpha, largest remainders first. One row for each key value, few by nature."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    all_, total_ = Window.partitionBy(), F.lit(total) if total is not None else F.sum("n").over(Window.partitionBy())
    wanted = counts.withColumn("wanted", F.pow(F.col("n").cast("double"), F.lit(alpha)) / F.sum(F.pow(F.col("n").cast("double"), F.lit(alpha))).over(all_) * total_)
    wanted = wanted.withColumn("base", F.floor("wanted")).withColumn("rest", total_ - F.sum("base").over(all_) if total is not None else F.sum("n").over(all_) - F.sum("base").over(all_))
    order = Window.orderBy(F.round(F.col("base") - F.col("wanted"), 9), key)
    return wanted.select(key, "n", (F.col("base") + (F.row_number().over(order) <= F.col("rest")).cast("long")).alias("target"))


def resample(rows: DataFrame, key: str, id_: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Fewer rows are taken by hash order, more by drawing with replacement: draw k of a key takes row hash(key, k) mod n.

    Ranks within a key come from one window; draws are generated, so nothing is collected.
    """
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(id_, F.lit(seed)), id_)))
    under = ranked.join(targets.where("target <= n"), key).where(F.col("__rank") <= F.col("target")).drop("n", "target", "__rank")
    draws = targets.where("target > n").withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("target")))).withColumn("__rank", (F.pmod(F.xxhash64(key, "__draw", F.lit(seed)), F.col("n")) + 1).cast("int"))
    over = ranked.join(draws.select(key, "__rank"), [key, "__rank"]).drop("__rank")
    return under.unionByName(over)


def split_column(id_: str) -> Column:
    """Deterministic split by id."""
    return F.when(F.col(id_) % 10 == 0, "test").when(F.col(id_) % 10 == 1, "validation").otherwise("train")


def seeded_sample(rows: DataFrame, keys: list[str], id_: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` of each group in the order of a seeded hash."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(id_, F.lit(seed)), id_)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def reuters_text(text: Column) -> Column:
    """one line, and no closing " reuter"."""
    return F.trim(F.regexp_replace(tx.collapse(text), "(?i)\\sreuter$", ""))


def language_plan(languages: DataFrame, subsets: DataFrame) -> DataFrame:
    """Run, or skipped without a subset. ``languages``: language; ``subsets``: language, subset."""
    status = F.when(F.col("subset").isNotNull(), "run").otherwise("skipped_no_xlsum_subset")
    return languages.join(subsets, "language", "left").select("language", F.coalesce("subset", F.lit("")).alias("subset"), status.alias("status"))


def training_columns(rows: DataFrame, language_code: str) -> DataFrame:
    """Summary becomes target, and the language code is a column."""
    named = rows.withColumnRenamed("summary", "target") if "target" not in rows.columns else rows
    return named.withColumn("language_code", F.lit(language_code))


def preferred_order(language: Column) -> list[Column]:
    """Turkish first, the others by name."""
    return [F.when(language == "tr", 0).otherwise(1), language]


def translated(text: Column, source: Column, target: Column, known: tuple[str, ...], translate=None) -> Column:
    """Text, applied, target. ``translate`` (a column function) is asked where languages differ and are known; without one the text stays."""
    asked = (source != target) & source.isin(*known) & target.isin(*known)
    new = F.when(asked, translate(text, source, target)).otherwise(text) if translate else text
    return F.struct(new.alias("text"), (~new.eqNullSafe(text)).alias("translation_applied"), target.alias("output_language"))


# --- queries ----------------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _measured(spark, sf_dir) -> DataFrame:
    t, s = F.col("text"), F.left("text", F.lit(280))
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("language"), split_column("doc_id").alias("split"), F.length(tx.collapse(t)).alias("text_chars"), F.length(tx.collapse(s)).alias("summary_chars"), tx.token_like_count(t).alias("text_tokens"), tx.token_like_count(s).alias("summary_tokens"))


_TOKENS_SQL = rf"(len(regexp_extract_all(@, '{CJK_WIDE_SQL}')) + len(regexp_extract_all(regexp_replace(@, '{CJK_WIDE_SQL}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')))"
_MEASURED = f"m AS (SELECT doc_id, lang AS language, {SPLIT_SQL} AS split, length({collapse_sql('text')}) AS text_chars, length({collapse_sql('left(text, 280)')}) AS summary_chars, {_TOKENS_SQL.replace('@', collapse_sql('text'))} AS text_tokens, {_TOKENS_SQL.replace('@', collapse_sql('left(text, 280)'))} AS summary_tokens FROM documents)"


def a4_length_summary(spark, sf_dir):
    d = _measured(spark, sf_dir)
    return describe(d, ["language", "split"], ["text_chars", "text_tokens", "summary_chars"])


def a5_missing_fields(spark, sf_dir):
    d = docs(spark, sf_dir)
    empty = lambda c: F.count_if(tx.collapse(c) == "")
    return d.groupBy("lang").agg(empty(F.col("text")).alias("missing_text"), empty(F.when(F.col("doc_id") % 7 != 0, F.col("source"))).alias("missing_source"))


def a6_surplus_duplicates(spark, sf_dir):
    t = docs(spark, sf_dir).select("lang", tx.collapse(F.col("text")).alias("t")).where("t <> ''")
    return t.groupBy("lang").agg((F.count("t") - F.countDistinct("t")).alias("duplicates"))


def a7_split_shares(spark, sf_dir):
    c = docs(spark, sf_dir).select(F.col("lang").alias("language"), split_column("doc_id").alias("split")).groupBy("language", "split").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("split"))
    return c.select("language", "split", "n", whole.alias("split_total"), (F.col("n") / whole).alias("share"))


def a8_split_macro(spark, sf_dir):
    by = _measured(spark, sf_dir).groupBy("language", "split").agg(F.count("*").alias("rows"), F.avg("text_tokens").alias("mean_tokens"))
    return by.groupBy("split").agg(F.sum("rows").alias("rows"), F.avg("mean_tokens").alias("mean_tokens"))


def a15_language_distribution(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", split_column("doc_id").alias("split"))
    return d.groupBy("lang").pivot("split", ["train", "validation", "test"]).count().na.fill(0)


def d6_row_metrics(spark, sf_dir):
    return _measured(spark, sf_dir).select("doc_id", "text_chars", "text_tokens", "summary_tokens", F.round(F.try_divide("summary_tokens", "text_tokens"), 9).alias("compression"))


def d7_overlap_novelty(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", overlap_tokens(F.col("text")).alias("t"), overlap_tokens(F.right("text", F.lit(150))).alias("s"))
    out = []
    for n in (1, 2):
        s = gram_set(F.col("s"), n)
        share = F.try_divide(F.size(F.array_intersect(s, gram_set(F.col("t"), n))), F.size(s))
        out += [F.round(share, 9).alias(f"overlap_{n}"), F.round(1 - share, 9).alias(f"novelty_{n}")]
    return d.select("doc_id", *out)


def d8_compression_heatmap(spark, sf_dir):
    d = _measured(spark, sf_dir).withColumn("c", F.try_divide("summary_tokens", "text_tokens"))
    return d.groupBy("language").pivot("split", ["train", "validation", "test"]).agg(F.round(F.avg("c"), 9))


def r1_seeded_sample(spark, sf_dir):
    return seeded_sample(docs(spark, sf_dir).select("lang", "doc_id"), ["lang"], "doc_id", 5)


def r3_alpha_targets(spark, sf_dir):
    return alpha_targets(docs(spark, sf_dir), "lang")


def r3_resampled_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    return resample(d.select("doc_id", "lang"), "lang", "doc_id", alpha_targets(d, "lang")).groupBy("lang").agg(F.count("*").alias("n"))


def f15_reuters_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", reuters_text(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n REUTER").otherwise(""))).alias("text"))


def f16_source_order(spark, sf_dir):
    d = docs(spark, sf_dir).where("lang = 'en'").select("source").distinct()
    return d.orderBy("source").limit(7)


def o17_language_order(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.when(F.col("lang") == "fr", "tr").otherwise(F.col("lang")).alias("lang")).distinct()
    return d.select("lang", F.row_number().over(Window.orderBy(*preferred_order(F.col("lang")))).cast("long").alias("place"))


def o18_head_rows(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")))
    return d.where("n <= 3").select("lang", "source", "doc_id")


def r4_split(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(split_column("doc_id").alias("split")).agg(F.count("*").alias("n"))


def r8_language_plan(spark, sf_dir):
    langs = docs(spark, sf_dir).select(F.col("lang").alias("language")).distinct()
    return language_plan(langs, langs.where("language <> 'de'").select("language", F.concat(F.lit("xl_"), F.col("language")).alias("subset")))


def s6_page_lookup(spark, sf_dir):
    """One fetch for each (url, source): distinct keys are looked up, and the answers joined back."""
    p = table(spark, sf_dir, "pages")
    asked = p.select("url", (F.col("page_id") % 3).alias("source")).unionByName(p.select("url", (F.col("page_id") % 3).alias("source")))
    fetched = asked.dropDuplicates(["url", "source"]).join(p.groupBy("url").agg(F.max(F.length("html")).alias("n")), "url")
    return asked.join(fetched, ["url", "source"]).groupBy("source").agg(F.count("*").alias("asked"), F.sum("n").alias("chars"))


def t6_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(tx.clean(F.col("text")))).alias("i", "sentence")).select("doc_id", F.col("i").cast("long").alias("i"), "sentence")


def t7_cjk_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.cjk_count(F.concat("text", F.lit("漢字かな한글"))).cast("long").alias("n"))


def t8_word_like_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.word_like_count(tx.clean(F.col("text"))).cast("long").alias("n"))


def t9_code_noise(spark, sf_dir):
    d = docs(spark, sf_dir)
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" font-family: x"))).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" let x"))).otherwise(F.col("text"))
    return d.select("doc_id", tx.code_noise(marked).alias("noise"))


def t11_t12_near_duplicates(spark, sf_dir):
    """Shared words of every (document, item) pair, over whole texts; a frequent word alone makes a row of nearly every pair, which partial counts take in before the shuffle."""
    d = docs(spark, sf_dir).select("doc_id", tx.word_set(tx.clean(F.col("text"))).alias("w")).select("doc_id", F.size("w").alias("a"), "w")
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.word_set(tx.clean(F.col("text"))).alias("v")).select("item_id", F.size("v").alias("b"), "v")
    words = d.select("doc_id", "a", F.explode("w").alias("x")).join(b.select("item_id", "b", F.explode("v").alias("x")), "x")
    pairs = words.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("a").alias("a"), F.first("b").alias("b"))
    return pairs.where("shared * 1.0 / least(a, b) >= 0.3").select("doc_id", "item_id", "shared")


def t14_datetime_like(spark, sf_dir):
    d = docs(spark, sf_dir)
    s = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" 12:30 "))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Am 3 Mart "), "text")).otherwise(F.col("text"))
    return d.select("doc_id", tx.datetime_like(tx.collapse(s)).alias("dated"))


def t22_sentence_ending(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.sentence_ending(F.col("text")).alias("ended"))


def t3_mojibake(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.mojibake_count(F.col("text")).alias("n"))


def e1_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


def e6_paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("i", "p"))
    return p.select("page_id", F.col("i").cast("long").alias("i"), tx.strip_html(F.col("p")).alias("text")).where(F.length("text") >= 40)


def e10_images(spark, sf_dir):
    made = F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:image" content="u'), F.col("page_id").cast("string"), F.lit('">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<meta content="v'), F.col("page_id").cast("string"), F.lit('" name="twitter:image">'))).otherwise(F.lit("")), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", image_of(made).alias("image"))


def image_of(html: Column) -> Column:
    """Og:image, then twitter:image, either order of attributes, then the first image of the article."""
    found = []
    for name in ("og:image", "twitter:image"):
        found += [rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]+content=["']([^"']+)["']""", rf"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["']{name}["']"""]
    found.append(r"""(?is)<article\b.*?<img[^>]+src=["']([^"']+)["']""")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in found], F.lit(""))


_NAMES = "f15_reuters_text f16_source_order o17_language_order o18_head_rows r4_split r8_language_plan s6_page_lookup a4_length_summary a5_missing_fields a6_surplus_duplicates a7_split_shares a8_split_macro a15_language_distribution d6_row_metrics d7_overlap_novelty d8_compression_heatmap r1_seeded_sample r3_alpha_targets r3_resampled_counts t3_mojibake t6_sentences t7_cjk_count t8_word_like_count t9_code_noise t11_t12_near_duplicates t14_datetime_like t22_sentence_ending e1_strip_html e6_paragraphs e10_images"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_CLEAN = rf"trim(regexp_replace(regexp_replace(replace(@, chr(8203), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', ' ', 'g'), {SPACE_SQL}, ' ', 'g'))"


def clean_sql(t: str) -> str:
    return _CLEAN.replace('@', t)


_OV = rf"regexp_extract_all(regexp_replace(lower(@), '{CJK_WIDE_SQL}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')"


def _grams(t: str) -> str:
    return f"list_distinct(CASE WHEN len({t}) >= 2 THEN list_transform(range(1, len({t})), lambda i: {t}[i] || chr(1) || {t}[i + 1]) ELSE [] END)"


_TGT = "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT *, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () AS wanted FROM c), b AS (SELECT *, floor(wanted) AS base FROM w), t AS (SELECT lang, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY round(base - wanted, 9), lang) <= sum(n) OVER () - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM b)"
_TAGS = "regexp_replace({}, '<[^>]+>', ' ', 'g')"
_REUTER = "text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' REUTER' ELSE '' END"
_DATED = "CASE doc_id % 4 WHEN 0 THEN text || ' 12:30 ' WHEN 1 THEN 'Am 3 Mart ' || text ELSE text END"
_MARKED = "CASE doc_id % 5 WHEN 0 THEN text || ' font-family: x' WHEN 1 THEN text || ' let x' ELSE text END"


def _plain(pattern: str) -> str:
    """A pattern without looking around: what stands beside it is matched too."""
    return pattern.replace(tx.LEFT, r"(?:^|[^\p{L}\p{N}_])").replace(tx.RIGHT, r"(?:$|[^\p{L}\p{N}_])").replace("'", "''")


def _times(part: str) -> str:
    return f"(length(t) - length(replace(t, '{part}', ''))) / {len(part)}"


_WS = r"list_distinct(list_filter(regexp_extract_all(lower(@), '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?'), lambda x: length(x) > 2))"

ORACLE = {
    "a4_length_summary": f"WITH {_MEASURED} SELECT language, split, {describe_sql('text_chars')}, {describe_sql('text_tokens')}, {describe_sql('summary_chars')} FROM m GROUP BY language, split",
    "a5_missing_fields": f"SELECT lang, count(*) FILTER ({collapse_sql('text')} = '') AS missing_text, count(*) FILTER (doc_id % 7 = 0 OR {collapse_sql('source')} = '') AS missing_source FROM documents GROUP BY lang",
    "a6_surplus_duplicates": f"WITH t AS (SELECT lang, {collapse_sql('text')} AS t FROM documents) SELECT lang, count(t) - count(DISTINCT t) AS duplicates FROM t WHERE t <> '' GROUP BY lang",
    "a7_split_shares": f"WITH c AS (SELECT lang AS language, {SPLIT_SQL} AS split, count(*) AS n FROM documents GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_total, n / sum(n) OVER (PARTITION BY split) AS share FROM c",
    "a8_split_macro": f"WITH {_MEASURED}, l AS (SELECT language, split, count(*) AS n, avg(text_tokens) AS a FROM m GROUP BY ALL) SELECT split, CAST(sum(n) AS BIGINT) AS rows, avg(a) AS mean_tokens FROM l GROUP BY split",
    "a15_language_distribution": "SELECT lang, count(*) FILTER (doc_id % 10 > 1) AS train, count(*) FILTER (doc_id % 10 = 1) AS validation, count(*) FILTER (doc_id % 10 = 0) AS test FROM documents GROUP BY lang",
    "d6_row_metrics": f"WITH {_MEASURED} SELECT doc_id, text_chars, text_tokens, summary_tokens, round(summary_tokens / nullif(text_tokens, 0), 9) AS compression FROM m",
    "d7_overlap_novelty": f"WITH a AS (SELECT doc_id, {_OV.replace('@', collapse_sql('text'))} AS t, {_OV.replace('@', collapse_sql('right(text, 150)'))} AS s FROM documents), g AS (SELECT doc_id, list_distinct(s) AS s1, list_distinct(t) AS t1, {_grams('s')} AS s2, {_grams('t')} AS t2 FROM a) SELECT doc_id, " + ", ".join(f"round(len(list_intersect(s{n}, t{n})) / nullif(len(s{n}), 0), 9) AS overlap_{n}, round(1 - len(list_intersect(s{n}, t{n})) / nullif(len(s{n}), 0), 9) AS novelty_{n}" for n in (1, 2)) + " FROM g",
    "d8_compression_heatmap": f"WITH {_MEASURED} SELECT language, " + ", ".join(f"round(avg(summary_tokens / nullif(text_tokens, 0)) FILTER (split = '{s}'), 9) AS {s}" for s in ("train", "validation", "test")) + " FROM m GROUP BY language",
    "r3_alpha_targets": f"WITH {_TGT} SELECT * FROM t",
    "r3_resampled_counts": f"WITH {_TGT} SELECT lang, target AS n FROM t",
    "t6_sentences": f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({clean_sql('text')}, '([.!?…。！？؟])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS sentence FROM s",
    "t7_cjk_count": f"SELECT doc_id, len(regexp_extract_all(text || '漢字かな한글', '{CJK_SQL}')) AS n FROM documents",
    "t14_datetime_like": f"SELECT doc_id, regexp_matches(lower({collapse_sql(_DATED)}), '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join((*tx.DATE_SHAPES, *tx.MONTHS_TR, *tx.MONTHS_EN))})($|[^\\p{{L}}\\p{{N}}_])') AS dated FROM documents",
    "t22_sentence_ending": "SELECT doc_id, regexp_matches(rtrim(text, chr(32)), '[.!?…。！？؟][\"''”’»)\\]]*$') AS ended FROM documents",
    "t3_mojibake": "SELECT doc_id, CAST((length(text) - length(replace(replace(replace(text, 'â', ''), 'Ã', ''), 'Â', ''))) AS BIGINT) AS n FROM documents",
    "t11_t12_near_duplicates": f"WITH d AS (SELECT doc_id, {_WS.replace('@', clean_sql('text'))} AS w FROM documents), b AS (SELECT item_id, {_WS.replace('@', clean_sql('text'))} AS v FROM benchmark), x AS (SELECT doc_id, len(w) AS a, unnest(w) AS x FROM d), y AS (SELECT item_id, len(v) AS b, unnest(v) AS x FROM b) SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (x) GROUP BY doc_id, item_id, a, b HAVING count(*) * 1.0 / least(a, b) >= 0.3",
    "e10_images": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'u' || page_id WHEN 1 THEN 'v' || page_id ELSE '' END AS image FROM pages",
    "t8_word_like_count": rf"SELECT doc_id, greatest(len(regexp_extract_all({clean_sql('text')}, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?')), len(regexp_extract_all(text, '{CJK_SQL}')) // 2) AS n FROM documents",
    "f15_reuters_text": f"SELECT doc_id, trim(regexp_replace({collapse_sql(_REUTER)}, '(?i)\\sreuter$', '')) AS text FROM documents",
    "f16_source_order": "SELECT DISTINCT source FROM documents WHERE lang = 'en' ORDER BY source LIMIT 7",
    "o17_language_order": "WITH l AS (SELECT DISTINCT CASE lang WHEN 'fr' THEN 'tr' ELSE lang END AS lang FROM documents) SELECT lang, row_number() OVER (ORDER BY lang <> 'tr', lang) AS place FROM l",
    "o18_head_rows": "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 3",
    "r4_split": f"SELECT {SPLIT_SQL} AS split, count(*) AS n FROM documents GROUP BY 1",
    "r8_language_plan": "SELECT DISTINCT lang AS language, CASE WHEN lang <> 'de' THEN 'xl_' || lang ELSE '' END AS subset, CASE WHEN lang <> 'de' THEN 'run' ELSE 'skipped_no_xlsum_subset' END AS status FROM documents",
    "s6_page_lookup": "WITH p AS (SELECT url, max(length(html)) AS n FROM pages GROUP BY url) SELECT page_id % 3 AS source, CAST(2 * count(*) AS BIGINT) AS asked, CAST(2 * sum(n) AS BIGINT) AS chars FROM pages JOIN p USING (url) GROUP BY 1",
    "t9_code_noise": f"WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?i)({'|'.join(map(_plain, tx.CODE_NOISE))})') OR (length(t) <= 240 AND regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])(function|const|let|var)($|[^\\p{{L}}\\p{{N}}_])')) OR (contains(t, ':') AND (({_times('{')} + {_times('}')} >= 2 AND {_times(';')} >= 2 AND {_times(':')} >= 3) OR ({_times('{' + chr(34))} >= 2 AND {_times(chr(34) + ':')} >= 5) OR ({_times(chr(34) + ',' + chr(34))} >= 5 AND {_times(':')} >= 8))) AS noise FROM m",
    "e1_strip_html": f"SELECT page_id, {clean_sql(_TAGS.format('html'))} AS text FROM pages",
    "e6_paragraphs": f"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS l FROM pages), q AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS p FROM p), r AS (SELECT page_id, i, {clean_sql(_TAGS.format('p'))} AS text FROM q) SELECT * FROM r WHERE length(text) >= 40",
}

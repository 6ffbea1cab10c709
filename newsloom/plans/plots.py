"""Data behind the plots over all 25 metrics: small multiples, scatter pairs, pair plot, densities, ranks and cross-run deltas; missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.densities import densities
from newsloom.plans import evaluation as ev
from newsloom.plans.evaluation import METRICS, collapse_sql
from newsloom.session import table

#: Groups of metrics that share a figure, pairs of a scatter plot, and metrics of the pair plot.
GROUPS = {
    "classical": ("rouge1_fmeasure", "rouge2_fmeasure", "rougeL_fmeasure", "bleu", "meteor_lite"),
    "capability": ("capability_coherence", "capability_accuracy", "capability_clarity", "capability_relevance", "capability_efficiency", "capability_overall"),
    "quality_grounding": ("quality_factuality", "quality_completeness", "source_coverage", "source_recall", "fragment_coverage", "fragment_density"),
}
PAIRS = (
    ("source_tokens", "latency_seconds"), ("source_tokens", "summary_tokens"), ("compression_ratio", "capability_overall"), ("compression_ratio", "rougeL_fmeasure"),
    ("latency_per_1k_tokens", "capability_efficiency"), ("source_coverage", "quality_factuality"), ("source_recall", "capability_relevance"), ("rougeL_fmeasure", "capability_accuracy"),
    ("repetition_3gram", "capability_clarity"), ("novelty_2gram", "rougeL_fmeasure"), ("fragment_density", "novelty_2gram"), ("summary_tokens", "quality_completeness"),
)
CENTRAL = ("capability_overall", "rougeL_fmeasure", "meteor_lite", "quality_factuality", "compression_ratio", "latency_seconds")
PLOT_ROWS, PAIRPLOT_ROWS = 2000, 9000


def small_multiples(rows: DataFrame) -> DataFrame:
    """Group, metric, language, model and the mean: a line for each model in a panel for each metric."""
    of = {m: g for g, ms in GROUPS.items() for m in ms}
    means = ev.long(rows, ["language", "model"], list(of)).groupBy("metric", "language", "model").agg(F.avg("value").alias("mean"))
    group = F.coalesce(*[F.when(F.col("metric").isin(*ms), g) for g, ms in GROUPS.items()])
    return means.select(group.alias("group"), "metric", "language", "model", "mean")


def drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """R2: ``n`` rows by hash; the number is the plot's."""
    return rows.orderBy(F.xxhash64("sample_id", "model", F.lit(seed)), "sample_id", "model").limit(n)


def scatter_pairs(rows: DataFrame, n: int = PLOT_ROWS, seed: int = 42) -> DataFrame:
    """The same drawn rows as points of all twelve pairs."""
    each = F.array(*[F.struct(F.lit(a).alias("x_metric"), F.lit(b).alias("y_metric"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in PAIRS])
    return drawn(rows, n, seed).select("sample_id", "model", F.explode(each).alias("p")).select("sample_id", "model", "p.*").where("x is not null and y is not null")


def pair_plot(rows: DataFrame, n: int = PAIRPLOT_ROWS, seed: int = 123) -> DataFrame:
    """Complete rows of the six central metrics."""
    return drawn(rows.select("sample_id", "model", *CENTRAL).na.drop(subset=list(CENTRAL)), n, seed)


def cross_run(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric the last run's mean (by name) less the first one's, where both have the language and model."""
    means = ev.long(rows, ["run", "language", "model"], metrics).groupBy("run", "language", "model", "metric").agg(F.avg("value").alias("mean"))
    ends = rows.agg(F.min("run").alias("first"), F.max("run").alias("last"))
    sided = means.join(F.broadcast(ends), (F.col("run") == F.col("first")) | (F.col("run") == F.col("last")))  # one row
    by = sided.where("first < last").groupBy("language", "model", "metric").agg(F.max(F.when(F.col("run") == F.col("first"), F.col("mean"))).alias("left"), F.max(F.when(F.col("run") == F.col("last"), F.col("mean"))).alias("right"))
    return by.where("left is not null and right is not null").select("language", "model", "metric", "left", "right", (F.col("right") - F.col("left")).alias("delta"))


def missing_fields(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A5: rows of each group whose field is null or empty after white space is collapsed, for every field."""
    return rows.groupBy(*keys).agg(*[F.count_if(tx.collapse(F.col(c).cast("string")) == "").alias(f"missing_{c}") for c in columns])


# --- queries --------------------------------------------------------------------------------------


def p8_small_multiples(spark, sf_dir):
    return small_multiples(ev._all(spark, sf_dir))


def p12_scatter_pairs(spark, sf_dir):
    return scatter_pairs(ev._all(spark, sf_dir))


def p13_pair_plot(spark, sf_dir):
    return pair_plot(ev._all(spark, sf_dir))


def p10_densities(spark, sf_dir):
    return densities(ev.long(ev._all(spark, sf_dir), ["model"], list(METRICS)), ["metric", "model"], "value")


def o7_all_metrics(spark, sf_dir):
    """Ranks of models by the mean of every metric."""
    means = ev._all(spark, sf_dir).groupBy("model").agg(*[F.avg(c).alias(c) for c in METRICS])
    return ev.ranks(ev.long(means, ["model"], list(METRICS)), ["metric"]).select("metric", "model", "value", F.col("rank").cast("long"))


def r7_all_metrics(spark, sf_dir):
    run = F.when(F.col("sample_id").cast("long") % 2 == 0, "run_a").otherwise("run_b")
    return cross_run(ev._all(spark, sf_dir).withColumn("run", run), list(METRICS))


def a5_all_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = d.select("lang", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url"), F.when(F.col("doc_id") % 5 != 0, F.substring_index("text", "\n", 1)).alias("title"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("summary"), "text")
    return missing_fields(made, ["lang"], ["id", "url", "title", "summary", "text"])


QUERIES = {f.__name__: f for f in (p8_small_multiples, p12_scatter_pairs, p13_pair_plot, p10_densities, o7_all_metrics, r7_all_metrics, a5_all_fields)}
_EMPTY = "count(*) FILTER (" + collapse_sql("@") + " = '')"
ORACLE = {
    "a5_all_fields": r"WITH m AS (SELECT lang, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 11 <> 0 THEN 'u' || doc_id END AS url, CASE WHEN doc_id % 5 <> 0 THEN split_part(text, chr(10), 1) END AS title, regexp_replace(text, '^[^\n]*\n?', '') AS summary, text FROM documents) SELECT lang, "
    + ", ".join(f"{_EMPTY.replace('@', c)} AS missing_{c}" for c in ("id", "url", "title", "summary", "text"))
    + " FROM m GROUP BY lang",
}

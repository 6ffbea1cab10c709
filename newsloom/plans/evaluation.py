"""Summary evaluation: metric rows, aggregates over models and languages, rankings, wins, deltas, and the data behind plots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import metrics as m
from newsloom.operators.ranks import ecdf, percentiles
from newsloom.session import table
from newsloom.storage import Stored

MODELS = ("mbart-xlsum-2", "mbart50_xlsum", "mt5-xlsum")
#: Direction of metrics: everything is better when higher, but for these.
LOWER_IS_BETTER = ("latency_seconds", "latency_per_1k_tokens", "repetition_3gram", "sentence_len_std")
#: Metrics that SQL can say.
CORE = ("rouge1_fmeasure", "rouge2_fmeasure", "novelty_1gram", "novelty_2gram", "repetition_3gram", "summary_tokens", "source_tokens", "compression_ratio", "source_coverage", "source_recall", "latency_seconds", "latency_per_1k_tokens")
#: The metrics that are aggregated by language and model.
METRICS = (
    "rouge1_fmeasure", "rouge2_fmeasure", "rougeL_fmeasure", "bleu", "meteor_lite",
    "capability_coherence", "capability_accuracy", "capability_clarity", "capability_relevance",
    "capability_efficiency", "capability_overall", "quality_factuality", "quality_completeness",
    "latency_seconds", "latency_per_1k_tokens", "compression_ratio", "source_coverage",
    "source_recall", "fragment_coverage", "fragment_density", "novelty_1gram", "novelty_2gram",
    "repetition_3gram", "summary_tokens", "source_tokens",
)


def evaluate(rows: DataFrame) -> DataFrame:
    """36 metric columns from source_text, reference_summary, generated_summary, latency_seconds and language."""
    t = rows.withColumn("__found", m.text_held_by_pieces(lowered(F.col("source_text")), F.array(lowered(F.col("generated_summary")))))
    t = t.withColumns({"__held": F.get("__found.made", F.lit(0)), "__n": F.col("__found.n"), "__r": lowered(F.col("reference_summary"))})
    return measured(t.drop("__found"))


def lowered(text):
    return F.lower(F.coalesce(text, F.lit("")))


def measured(t: DataFrame) -> DataFrame:
    """The metric columns of rows with summaries, references in lower case (__r), the number of the source's (__n) and what the source has of the summary (__held)."""
    x, held = F.col("__x"), F.col("__held")
    r, g = x["r"], x["g"]
    two = lambda n: F.greatest(n - 1, F.lit(0))
    t = t.withColumn("__x", m.compared_fully("__r", lowered(F.col("generated_summary")), F.coalesce(F.col("language") == "en", F.lit(False))))
    t = t.withColumns({"bleu": x["bleu"], "meteor": x["meteor"]})
    t = t.withColumns({"source_tokens": F.col("__n").cast("double"), "reference_tokens": r.cast("double"), "summary_tokens": g.cast("double")})
    t = t.withColumn("compression_ratio", F.coalesce(F.try_divide("source_tokens", "summary_tokens"), F.lit(0.0)))
    for name, (p, c, f) in {"rouge1": m.prf(x["one"], g, r), "rouge2": m.prf(x["two"], two(g), two(r)), "rougeL": m.prf(x["lcs"], g, r)}.items():
        t = t.withColumns({f"{name}_precision": p, f"{name}_recall": c, f"{name}_fmeasure": f})
    shared = held["shared"]
    t = t.withColumns(
        {
            "meteor_lite": F.col("meteor"),
            "source_coverage": F.coalesce(F.try_divide(shared, x["distinct"]), F.lit(0.0)),
            "source_recall": F.coalesce(F.try_divide(shared, held["distinct"]), F.lit(0.0)),
            "fragment_coverage": held["coverage"],
            "fragment_density": held["density"],
            "novelty_1gram": m.new_share(held["held1"], g),
            "novelty_2gram": m.new_share(held["held2"], two(g)),
            "repetition_3gram": x["repetition"],
            "avg_sentence_len": x["mean"],
            "sentence_len_std": x["std"],
            "flesch_reading_ease": x["flesch"],
            "latency_per_1k_tokens": F.col("latency_seconds") / F.greatest(F.col("source_tokens") / 1000, F.lit(1e-6)),
        }
    )
    ideal = m.ideal_length(F.col("avg_sentence_len"), F.col("language"))
    fresh = 1 - F.col("repetition_3gram")
    readable = F.coalesce(m.clamp01((F.col("flesch_reading_ease") + 20) / 120), ideal)
    aligned = m.clamp01(1 - F.abs(F.col("summary_tokens") - F.col("reference_tokens")) / F.greatest("reference_tokens", F.lit(1.0)))
    t = t.withColumns(
        {
            "capability_coherence": m.clamp01(0.5 * m.clamp01(1 - F.col("sentence_len_std") / 20) + 0.3 * fresh + 0.2 * ideal),
            "capability_accuracy": m.clamp01(0.7 * (F.col("rougeL_fmeasure") + F.col("bleu") + F.col("meteor")) / 3 + 0.3 * F.col("source_coverage")),
            "capability_clarity": m.clamp01(0.7 * readable + 0.3 * fresh),
            "capability_relevance": m.clamp01(0.7 * F.col("rouge1_recall") + 0.3 * F.col("source_recall")),
            "capability_efficiency": m.clamp01(0.6 / (1 + F.col("latency_per_1k_tokens")) + 0.4 * m.clamp01((F.col("compression_ratio") - 2) / 18)),
            "quality_factuality": m.clamp01(0.6 * F.col("source_coverage") + 0.4 * F.col("fragment_coverage")),
            "quality_completeness": m.clamp01(0.7 * F.col("rouge1_recall") + 0.3 * aligned),
        }
    )
    five = [F.col(f"capability_{k}") for k in ("coherence", "accuracy", "clarity", "relevance", "efficiency")]
    return t.withColumn("capability_overall", sum(five[1:], five[0]) / 5).drop("__n", "__r", "__held", "__x")


def statistics(rows: DataFrame) -> DataFrame:
    """Mean, median and deviation of each metric and model on long rows, which are made once."""
    kept = Stored(rows).df
    middle = percentiles(kept, ["metric", "model"], "value", {"median": 0.5}, kept=True).withColumnsRenamed({"metric": "__metric", "model": "__model"})
    by = kept.groupBy("metric", "model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    same = F.col("metric").eqNullSafe(F.col("__metric")) & F.col("model").eqNullSafe(F.col("__model"))
    return by.join(middle, same, "left").select("metric", "model", "mean", "median", "std")


def describe_by(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A1: mean and sample deviation of each metric, and the number of samples; null keys are groups."""
    return rows.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))], F.count("sample_id").alias("samples"))


def macro(by_language: DataFrame, rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of the language means, with counts joined on."""
    means = by_language.groupBy(*keys).agg(*[F.avg(f"{c}_mean").alias(f"{c}_mean") for c in metrics])
    counts = rows.groupBy(*keys).agg(F.count("sample_id").alias("samples"), F.countDistinct("language").alias("languages"))
    return means.join(counts, keys, "left")


def long(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Metric columns to rows."""
    return rows.unpivot(ids, metrics, "metric", "value")


def directed(metric: str = "metric", value: str = "value"):
    """The value, negated where lower is better: larger is always better."""
    return F.when(F.col(metric).isin(*LOWER_IS_BETTER), -F.col(value)).otherwise(F.col(value))


def ranks(long_rows: DataFrame, within: list[str]) -> DataFrame:
    """Competition rank in the metric's direction; null and NaN values have none."""
    good = long_rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(directed().desc())))


def winners(long_rows: DataFrame, within: list[str]) -> DataFrame:
    """The best model; among equals the first in model order."""
    order = Window.partitionBy(*within).orderBy(directed().desc(), "model")
    return long_rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def correlation(a: str, b: str):
    """A10: Pearson's coefficient, null where a column doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def complete(rows: DataFrame, metric: str) -> DataFrame:
    """Samples that every model has, one column for each model."""
    return rows.groupBy("language", "sample_id").pivot("model", list(MODELS)).agg(F.avg(metric)).na.drop()


#: Pairs of means that are held against each other.
TRADEOFFS = (("rouge1_fmeasure", "novelty_1gram"), ("rouge1_fmeasure", "latency_seconds"), ("compression_ratio", "source_coverage"), ("repetition_3gram", "rouge2_fmeasure"))


# --- queries --------------------------------------------------------------------------------------------


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """One row for each document, one column for each model's summary; the models' names."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    text = F.col("text")
    half = F.array_join(F.filter(F.slice(F.split(text, " ", 61), 1, 60), lambda x, i: i % 2 == 0), " ")
    made = {"mt5-xlsum": F.left(text, F.lit(200)), "mbart50_xlsum": F.right(text, F.lit(200)), "mbart-xlsum-2": half}
    base = d.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("language"), text.alias("source_text"), F.left(text, F.lit(120)).alias("reference_summary"), (F.col("n_chars") / 10000.0).alias("latency_seconds"), *[v.alias(k) for k, v in made.items()])
    return base, list(made)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, made = _made(spark, sf_dir)
    return base.unpivot(["sample_id", "language", "source_text", "reference_summary", "latency_seconds"], list(made), "model", "generated_summary")


def _sided(spark: SparkSession, sf_dir: str, found=m.text_held_by) -> DataFrame:
    """Rows of documents and models as ``measured`` reads them. A document's source and reference are read once, before its models' rows are made."""
    base, made = _made(spark, sf_dir)
    texts = F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"`{k}`").alias("generated_summary")) for k in made])
    t = base.select("sample_id", "language", "latency_seconds", lowered(F.col("reference_summary")).alias("__r"), texts.alias("made"), found(lowered(F.col("source_text")), F.array(*[lowered(F.col(f"`{k}`")) for k in made])).alias("found"))
    t = t.select("sample_id", "language", "latency_seconds", F.col("found.n").alias("__n"), "__r", F.explode(F.arrays_zip("made", F.col("found.made").alias("held"))).alias("x"))
    return t.select("sample_id", "language", "latency_seconds", "__n", "__r", "x.made.model", "x.made.generated_summary", F.col("x.held").alias("__held"))


def _core(spark, sf_dir) -> DataFrame:
    """The metrics of CORE."""
    t = _sided(spark, sf_dir).withColumn("__x", m.compared("__r", lowered(F.col("generated_summary"))))
    two = lambda n: F.greatest(n - 1, F.lit(0))
    x, n, held = F.col("__x"), F.col("__n").cast("double"), F.col("__held")
    r, g = x["r"], x["g"]
    shared = held["shared"]
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    found = {
        "rouge1_fmeasure": m.prf(x["one"], g, r)[2],
        "rouge2_fmeasure": m.prf(x["two"], two(g), two(r))[2],
        "novelty_1gram": m.new_share(held["held1"], g),
        "novelty_2gram": m.new_share(held["held2"], two(g)),
        "repetition_3gram": x["repetition"],
        "summary_tokens": g.cast("double"),
        "source_tokens": n,
        "compression_ratio": ratio(n, g),
        "source_coverage": ratio(shared, x["distinct"]),
        "source_recall": ratio(shared, held["distinct"]),
        "latency_seconds": F.col("latency_seconds").cast("double"),
        "latency_per_1k_tokens": F.col("latency_seconds") / F.greatest(n / 1000, F.lit(1e-6)),
    }
    return t.select("sample_id", "language", "model", *[F.round(v, 9).alias(k) for k, v in found.items()])


def m15_evaluation_rows(spark, sf_dir):
    return measured(_sided(spark, sf_dir, m.text_held_by_pieces)).drop("generated_summary")


def m5_rouge(spark, sf_dir):
    t = samples(spark, sf_dir).withColumns({"r": m.tokens(F.col("reference_summary")), "g": m.tokens(F.col("generated_summary"))})
    out = []
    for n in (1, 2):
        out += [c.alias(f"rouge{n}_{k}") for c, k in zip(m.rouge_n(F.col("r"), F.col("g"), n), ("precision", "recall", "fmeasure"), strict=True)]
    return t.select("sample_id", "model", *out)


def m9_m10_repetition_novelty(spark, sf_dir):
    return _core(spark, sf_dir).select("sample_id", "model", "novelty_1gram", "repetition_3gram")


def m12_sentence_lengths(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("n", m.sentence_lengths(F.col("generated_summary"))).select("sample_id", "model", F.round("n.mean", 6).alias("mean_length"), F.round("n.std", 6).alias("std_length"))


def m14_flesch(spark, sf_dir):
    return samples(spark, sf_dir).where("language = 'en'").select("sample_id", "model", F.round(m.flesch(F.col("generated_summary"), F.col("language")), 6).alias("flesch"))


def m15_vocabulary(spark, sf_dir):
    t = samples(spark, sf_dir).withColumns({"s": m.tokens(F.col("source_text")), "g": m.tokens(F.col("generated_summary"))})
    both = F.size(F.array_intersect("s", "g"))
    return t.select("sample_id", "model", F.round(F.coalesce(F.try_divide(both, F.size(F.array_distinct("g"))), F.lit(0.0)), 9).alias("coverage"), F.round(F.coalesce(F.try_divide(both, F.size(F.array_distinct("s"))), F.lit(0.0)), 9).alias("recall"))


def a1_language_summary(spark, sf_dir):
    return describe_by(_core(spark, sf_dir), ["language", "model"], list(CORE))


def a2_macro_summary(spark, sf_dir):
    rows = _core(spark, sf_dir)
    return macro(describe_by(rows, ["language", "model"], list(CORE)), rows, ["model"], list(CORE))


def a9_metric_statistics(spark, sf_dir):
    return statistics(long(_core(spark, sf_dir), ["model"], list(CORE)))


def a10_correlations(spark, sf_dir):
    rows = _core(spark, sf_dir)
    pairs = list(combinations(CORE, 2))
    wide = rows.groupBy("model").agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select("model", F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("x")).select("model", "x.pair", "x.r")


def a11_win_rates(spark, sf_dir):
    rows = long(_core(spark, sf_dir), ["language", "sample_id", "model"], list(CORE))
    won = winners(rows, ["metric", "language", "sample_id"]).groupBy("metric", "language", "model").agg(F.count("*").alias("wins"))
    return won.withColumn("rate", F.col("wins") / F.sum("wins").over(Window.partitionBy("metric", "language")))


def a18_ecdf(spark, sf_dir):
    rows = _core(spark, sf_dir).select("sample_id", "model", "rouge1_fmeasure")
    return ecdf(rows, ["model"], "rouge1_fmeasure").select("sample_id", "model", F.round("ecdf", 9).alias("ecdf"))


def a17_density(spark, sf_dir):
    cell = lambda c: F.least(F.floor(F.col(c) * 45), F.lit(44)).cast("int")
    return _core(spark, sf_dir).groupBy(cell("rouge1_fmeasure").alias("x"), cell("novelty_1gram").alias("y")).agg(F.count("*").alias("n"), F.round(F.log10(F.count("*")), 9).alias("log_n"))


def o7_metric_ranks(spark, sf_dir):
    means = _core(spark, sf_dir).groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in CORE])
    return ranks(long(means, ["model"], list(CORE)), ["metric"]).select("metric", "model", F.col("rank").cast("long"))


def o8_language_ranks(spark, sf_dir):
    means = _core(spark, sf_dir).groupBy("language", "model").agg(*[F.round(F.avg(c), 6).alias(c) for c in CORE])
    return ranks(long(means, ["language", "model"], list(CORE)), ["metric", "language"]).select("metric", "language", "model", F.col("rank").cast("long"))


def r0_heatmap(spark, sf_dir):
    wide = _core(spark, sf_dir).groupBy("language").pivot("model", list(MODELS)).agg(F.round(F.avg("rouge1_fmeasure"), 9))
    return wide.toDF("language", "m0", "m1", "m2")


def r5_language_deltas(spark, sf_dir):
    wide = _core(spark, sf_dir).groupBy("language").pivot("model", list(MODELS)).agg(F.avg("rouge1_fmeasure"))
    pairs = [F.struct(F.lit(f"{a} - {b}").alias("pair"), F.round(F.col(f"`{a}`") - F.col(f"`{b}`"), 9).alias("delta")) for a, b in combinations(MODELS, 2)]
    return wide.select("language", F.explode(F.array(*pairs)).alias("x")).select("language", "x.pair", "x.delta")


def r6_sample_deltas(spark, sf_dir):
    wide = complete(_core(spark, sf_dir), "rouge1_fmeasure")
    pairs = [F.struct(F.lit(f"{a} - {b}").alias("pair"), F.round(F.col(f"`{a}`") - F.col(f"`{b}`"), 9).alias("delta")) for a, b in combinations(MODELS, 2)]
    return wide.select("language", "sample_id", F.explode(F.array(*pairs)).alias("x")).select("language", "sample_id", "x.pair", "x.delta")


def r7_cross_run(spark, sf_dir):
    rows = _core(spark, sf_dir).withColumn("run", F.when(F.col("sample_id").cast("long") % 2 == 0, "run_a").otherwise("run_b"))
    by = rows.groupBy("language", "model").pivot("run", ["run_a", "run_b"]).agg(F.avg("rouge1_fmeasure")).na.drop()
    return by.select("language", "model", F.round(F.col("run_b") - F.col("run_a"), 9).alias("delta"))


def pairwise(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Differences between models of the means by ``keys``, for each metric; where both have one."""
    by = rows.groupBy(*keys, "model").agg(*[F.avg(c).alias(c) for c in metrics])  # only means become long
    means = long(by, [*keys, "model"], metrics).groupBy(*keys, "metric").pivot("model", list(MODELS)).agg(F.first("value"))
    pairs = [F.struct(F.lit(f"{a} - {b}").alias("pair"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("delta")) for a, b in combinations(MODELS, 2)]
    return means.select(*keys, "metric", F.explode(F.array(*pairs)).alias("x")).select(*keys, "metric", "x.pair", "x.delta").where("delta is not null")


def correlations(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Pearson's coefficient of every pair of metrics, over all rows (model "all") and for each model. One pass."""
    rows, pairs = Stored(rows).df, list(combinations(metrics, 2))
    parts = [correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = rows.groupBy("model").agg(*parts).unionByName(rows.agg(*parts).withColumn("model", F.lit("all")))
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select("model", F.explode(each).alias("x")).select("model", "x.*")


def scatter(rows: DataFrame, a: str, b: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` complete rows of two metrics, by hash; the limit is the plot's."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).orderBy(F.xxhash64("sample_id", "model", F.lit(seed)), "sample_id", "model").limit(n).select("model", "language", a, b)


def radar(by_model: DataFrame, metrics: list[str]) -> DataFrame:
    """Each model's means as axes; models with fewer than three values are left out."""
    axes = long(by_model, ["model"], metrics).where("value is not null")
    few = axes.groupBy("model").agg(F.count("*").alias("n")).where("n >= 3").select("model")
    return axes.join(few, "model", "left_semi")


def _all(spark, sf_dir) -> DataFrame:
    return measured(_sided(spark, sf_dir, m.text_held_by_pieces)).select("sample_id", "language", "model", *METRICS)


def a1_all_metrics(spark, sf_dir):
    return describe_by(_all(spark, sf_dir), ["language", "model"], list(METRICS))


def a2_all_metrics(spark, sf_dir):
    """A2 with O7's places: macro means of all metrics, best overall capability first."""
    by = describe_by(_all(spark, sf_dir), ["language", "model"], list(METRICS))
    means = by.groupBy("model").agg(*[F.avg(f"{c}_mean").alias(f"{c}_mean") for c in METRICS], F.sum("samples").alias("samples"), F.count("*").alias("languages"))
    return means.orderBy(F.col("capability_overall_mean").desc(), "model")


def a9_all_metrics(spark, sf_dir):
    return statistics(long(_all(spark, sf_dir), ["model"], list(METRICS)))


def a10_all_metrics(spark, sf_dir):
    return correlations(_all(spark, sf_dir), list(METRICS))


def a11_all_metrics(spark, sf_dir):
    rows = long(_all(spark, sf_dir), ["language", "sample_id", "model"], list(METRICS)).where("value is not null")
    won = winners(rows, ["metric", "language", "sample_id"]).groupBy("metric", "language", "model").agg(F.count("*").alias("wins"))
    return won.withColumn("rate", F.col("wins") / F.sum("wins").over(Window.partitionBy("metric", "language")))


def o8_all_metrics(spark, sf_dir):
    """Ranks of models by language and metric; rank 1 is the language's winner."""
    means = _all(spark, sf_dir).groupBy("language", "model").agg(*[F.avg(c).alias(c) for c in METRICS])
    return ranks(long(means, ["language", "model"], list(METRICS)), ["metric", "language"]).select("metric", "language", "model", "value", F.col("rank").cast("long"))


def r5_all_metrics(spark, sf_dir):
    return pairwise(_all(spark, sf_dir), ["language"], list(METRICS))


def r6_all_metrics(spark, sf_dir):
    return pairwise(_all(spark, sf_dir), ["language", "sample_id"], list(METRICS))


def p3_radar(spark, sf_dir):
    means = _core(spark, sf_dir).groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in CORE])
    return radar(means, list(CORE))


def p4_tradeoffs(spark, sf_dir):
    """Four pairs of model means."""
    means = _core(spark, sf_dir).groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in CORE])
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("x_mean"), F.col(b).alias("y_mean")) for a, b in TRADEOFFS])
    return means.select("model", F.explode(each).alias("p")).select("model", "p.*")


def p9_samples_by_language(spark, sf_dir):
    """Samples of each language, a language once, most samples first."""
    n = samples(spark, sf_dir).groupBy("language", "model").agg(F.count("*").alias("samples"))
    return n.groupBy("language").agg(F.max("samples").alias("samples")).orderBy(F.col("samples").desc(), "language")


def p12_scatter(spark, sf_dir):
    return scatter(_core(spark, sf_dir), "compression_ratio", "rouge1_fmeasure", 2000)


def p10_quartiles(spark, sf_dir):
    found = percentiles(_core(spark, sf_dir), ["model"], "rouge1_fmeasure", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return found.select("model", *[F.round(q, 9).alias(q) for q in ("q1", "q2", "q3")])


_NAMES = "m15_evaluation_rows m5_rouge m9_m10_repetition_novelty m12_sentence_lengths m14_flesch m15_vocabulary a1_language_summary a2_macro_summary a9_metric_statistics a10_correlations a11_win_rates a18_ecdf a17_density o7_metric_ranks o8_language_ranks r0_heatmap r5_language_deltas r6_sample_deltas r7_cross_run p10_quartiles a1_all_metrics a2_all_metrics a9_all_metrics a10_all_metrics a11_all_metrics o8_all_metrics r5_all_metrics r6_all_metrics p3_radar p4_tradeoffs p9_samples_by_language p12_scatter"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

SPACE_SQL = r"'[\s\x0b\p{Z}\x1c-\x1f\x{85}]+'"


def collapse_sql(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), {SPACE_SQL}, ' ', 'g'))"


def tokens_sql(t: str) -> str:
    return rf"regexp_extract_all(lower({collapse_sql(t)}), '[\p{{L}}\p{{N}}_''-]+')"


def sentences_sql(t: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({collapse_sql(t)}, '([.!?。！？؟])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def grams_sql(t: str, n: int) -> str:
    return t if n == 1 else f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], chr(1))) ELSE [] END"


SAMPLES_SQL = """(SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS language, text AS source_text, left(text, 120) AS reference_summary, n_chars / 10000.0 AS latency_seconds, model,
 CASE model WHEN 'mt5-xlsum' THEN left(text, 200) WHEN 'mbart50_xlsum' THEN right(text, 200)
 ELSE array_to_string(list_filter(string_split(text, ' ')[1:60], lambda x, i: i % 2 = 1), ' ') END AS generated_summary
 FROM documents, (VALUES ('mt5-xlsum'), ('mbart50_xlsum'), ('mbart-xlsum-2')) v(model) WHERE lang IS NOT NULL)"""
_TOK = f"t AS (SELECT *, {tokens_sql('source_text')} AS s, {tokens_sql('reference_summary')} AS r, {tokens_sql('generated_summary')} AS g FROM {SAMPLES_SQL})"
_GRAM = f"n AS (SELECT *, {grams_sql('r', 2)} AS r2, {grams_sql('g', 2)} AS g2, {grams_sql('g', 3)} AS g3 FROM t)"


def hits_sql(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


_H = f"h AS (SELECT *, {hits_sql('r', 'g')} AS h1, {hits_sql('r2', 'g2')} AS h2 FROM n)"
_P = "p AS (SELECT *, " + ", ".join(f"coalesce(h{n} / nullif(len(g{s}), 0), 0.0) AS p{n}, coalesce(h{n} / nullif(len(r{s}), 0), 0.0) AS c{n}" for n, s in ((1, ""), (2, "2"))) + " FROM h)"
_F = "f AS (SELECT *, " + ", ".join(f"coalesce(2 * p{n} * c{n} / nullif(p{n} + c{n}, 0), 0.0) AS f{n}" for n in (1, 2)) + " FROM p)"
_SHARED = "len(list_intersect(list_distinct(s), g))"
_CORE_SQL = {
    "rouge1_fmeasure": "f1",
    "rouge2_fmeasure": "f2",
    "novelty_1gram": "coalesce(1 - len(list_filter(g, lambda x: list_contains(s, x))) / nullif(len(g), 0), 0.0)",
    "novelty_2gram": "coalesce(1 - len(list_filter(g2, lambda x: list_contains(sh2, x))) / nullif(len(g2), 0), 0.0)",
    "repetition_3gram": "coalesce(1 - len(list_distinct(g3)) / nullif(len(g3), 0), 0.0)",
    "summary_tokens": "CAST(len(g) AS DOUBLE)",
    "source_tokens": "CAST(len(s) AS DOUBLE)",
    "compression_ratio": "coalesce(len(s) / nullif(len(g), 0), 0.0)",
    "source_coverage": f"coalesce({_SHARED} / nullif(len(list_distinct(g)), 0), 0.0)",
    "source_recall": f"coalesce({_SHARED} / nullif(len(list_distinct(s)), 0), 0.0)",
    "latency_seconds": "CAST(latency_seconds AS DOUBLE)",
    "latency_per_1k_tokens": "latency_seconds / greatest(len(s) / 1000, 1e-6)",
}
_CORE = f"WITH {_TOK}, {_GRAM}, {_H}, {_P}, {_F}, q AS (SELECT *, list_intersect(g2, {grams_sql('s', 2)}) AS sh2 FROM f), core AS (SELECT sample_id, language, model, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _CORE_SQL.items()) + " FROM q)"
_LONG = f"lg AS (UNPIVOT core ON {', '.join(CORE)} INTO NAME metric VALUE value)"
_DIR = f"CASE WHEN metric IN ({', '.join(repr(x) for x in LOWER_IS_BETTER)}) THEN -value ELSE value END"
_STATS = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in CORE)
_WIDE = "w AS (SELECT language, " + ", ".join(f"avg(rouge1_fmeasure) FILTER (model = '{x}') AS m{i}" for i, x in enumerate(MODELS)) + " FROM core GROUP BY language)"
_PAIRS = [(f"{a} - {b}", f"m{MODELS.index(a)} - m{MODELS.index(b)}") for a, b in combinations(MODELS, 2)]

ORACLE = {
    "m5_rouge": f"WITH {_TOK}, {_GRAM}, {_H}, {_P}, {_F} SELECT sample_id, model, p1 AS rouge1_precision, c1 AS rouge1_recall, f1 AS rouge1_fmeasure, p2 AS rouge2_precision, c2 AS rouge2_recall, f2 AS rouge2_fmeasure FROM f",
    "m9_m10_repetition_novelty": f"{_CORE} SELECT sample_id, model, novelty_1gram, repetition_3gram FROM core",
    "m12_sentence_lengths": f"WITH l AS (SELECT sample_id, model, list_transform({sentences_sql('generated_summary')}, lambda x: len({tokens_sql('x')})) AS n FROM {SAMPLES_SQL}) SELECT sample_id, model, round(coalesce(list_avg(n), 0.0), 6) AS mean_length, round(coalesce(list_stddev_pop(n), 0.0), 6) AS std_length FROM l",
    "m14_flesch": f"""WITH t AS (SELECT sample_id, model, list_filter({tokens_sql('generated_summary')}, lambda x: regexp_matches(x, '[a-z]')) AS w, greatest(1, len({sentences_sql('generated_summary')})) AS n FROM {SAMPLES_SQL} WHERE language = 'en'),
 y AS (SELECT *, list_sum(list_transform(list_transform(w, lambda x: regexp_replace(x, '[^a-z]', '', 'g')), lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syl FROM t)
 SELECT sample_id, model, round(CASE WHEN len(w) > 0 THEN 206.835 - 1.015 * (len(w) / n) - 84.6 * (syl / len(w)) END, 6) AS flesch FROM y""",
    "m15_vocabulary": f"WITH {_TOK} SELECT sample_id, model, round(coalesce(len(list_intersect(s, g)) / nullif(len(list_distinct(g)), 0), 0.0), 9) AS coverage, round(coalesce(len(list_intersect(s, g)) / nullif(len(list_distinct(s)), 0), 0.0), 9) AS recall FROM t",
    "a1_language_summary": f"{_CORE} SELECT language, model, {_STATS}, count(*) AS samples FROM core GROUP BY language, model",
    "a2_macro_summary": f"{_CORE}, l AS (SELECT language, model, {_STATS} FROM core GROUP BY ALL), a AS (SELECT model, " + ", ".join(f"avg({c}_mean) AS {c}_mean" for c in CORE) + " FROM l GROUP BY model), c AS (SELECT model, count(*) AS samples, count(DISTINCT language) AS languages FROM core GROUP BY model) SELECT * FROM a JOIN c USING (model)",
    "a9_metric_statistics": f"{_CORE}, {_LONG} SELECT metric, model, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std FROM lg GROUP BY ALL",
    "a10_correlations": f"{_CORE}, a AS (SELECT model, " + ", ".join(f'round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS "{a}|{b}"' for a, b in combinations(CORE, 2)) + " FROM core GROUP BY model) SELECT model, pair, r FROM a UNPIVOT INCLUDE NULLS (r FOR pair IN (" + ", ".join(f'"{a}|{b}"' for a, b in combinations(CORE, 2)) + "))",
    "a11_win_rates": f"{_CORE}, {_LONG}, w AS (SELECT metric, language, sample_id, model FROM lg QUALIFY row_number() OVER (PARTITION BY metric, language, sample_id ORDER BY {_DIR} DESC, model) = 1), c AS (SELECT metric, language, model, count(*) AS wins FROM w GROUP BY ALL) SELECT *, wins / sum(wins) OVER (PARTITION BY metric, language) AS rate FROM c",
    "a18_ecdf": f"{_CORE} SELECT sample_id, model, round(cume_dist() OVER (PARTITION BY model ORDER BY rouge1_fmeasure), 9) AS ecdf FROM core",
    "a17_density": f"{_CORE} SELECT CAST(least(floor(rouge1_fmeasure * 45), 44) AS INT) AS x, CAST(least(floor(novelty_1gram * 45), 44) AS INT) AS y, count(*) AS n, round(log10(count(*)), 9) AS log_n FROM core GROUP BY 1, 2",
    "o7_metric_ranks": f"{_CORE}, a AS (SELECT model, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in CORE) + f" FROM core GROUP BY model), lg AS (UNPIVOT a ON {', '.join(CORE)} INTO NAME metric VALUE value) SELECT metric, model, rank() OVER (PARTITION BY metric ORDER BY {_DIR} DESC) AS rank FROM lg",
    "o8_language_ranks": f"{_CORE}, a AS (SELECT language, model, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in CORE) + f" FROM core GROUP BY ALL), lg AS (UNPIVOT a ON {', '.join(CORE)} INTO NAME metric VALUE value) SELECT metric, language, model, rank() OVER (PARTITION BY metric, language ORDER BY {_DIR} DESC) AS rank FROM lg",
    "r0_heatmap": f"{_CORE}, {_WIDE} SELECT language, round(m0, 9) AS m0, round(m1, 9) AS m1, round(m2, 9) AS m2 FROM w",
    "r5_language_deltas": f"{_CORE}, {_WIDE} " + " UNION ALL ".join(f"SELECT language, '{n}' AS pair, round({d}, 9) AS delta FROM w" for n, d in _PAIRS),
    "r6_sample_deltas": f"{_CORE}, {_WIDE.replace('SELECT language,', 'SELECT language, sample_id,').replace('GROUP BY language', 'GROUP BY language, sample_id')} " + " UNION ALL ".join(f"SELECT language, sample_id, '{n}' AS pair, round({d}, 9) AS delta FROM w" for n, d in _PAIRS),
    "r7_cross_run": f"{_CORE}, x AS (SELECT language, model, avg(rouge1_fmeasure) FILTER (CAST(sample_id AS BIGINT) % 2 = 0) AS a, avg(rouge1_fmeasure) FILTER (CAST(sample_id AS BIGINT) % 2 <> 0) AS b FROM core GROUP BY ALL) SELECT language, model, round(b - a, 9) AS delta FROM x WHERE a IS NOT NULL AND b IS NOT NULL",
    "p3_radar": f"{_CORE}, a AS (SELECT model, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in CORE) + f" FROM core GROUP BY model) SELECT model, metric, value FROM (UNPIVOT a ON {', '.join(CORE)} INTO NAME metric VALUE value)",
    "p4_tradeoffs": f"{_CORE} " + " UNION ALL ".join(f"SELECT model, '{a}' AS x, '{b}' AS y, round(avg({a}), 6) AS x_mean, round(avg({b}), 6) AS y_mean FROM core GROUP BY model" for a, b in TRADEOFFS),
    "p9_samples_by_language": "SELECT lang AS language, count(*) AS samples FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "p10_quartiles": f"{_CORE} SELECT model, " + ", ".join(f"round(quantile_cont(rouge1_fmeasure, {q}), 9) AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM core GROUP BY model",
}

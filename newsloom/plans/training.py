"""Training rows and training-time metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import stems
from newsloom.plans.evaluation import samples
from newsloom.session import table

#: Tokens of a source and of a label, and the share of validation rows.
SOURCE_TOKENS, LABEL_TOKENS, VALIDATION = 1024, 128, 0.1
PAD, END = 1, 2


def seeded_split(rows: DataFrame, id_: str, share: float = VALIDATION, seed: int = 42) -> DataFrame:
    """Train or validation by a seeded hash of the id, so a row's side never depends on other rows."""
    part = F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 20)) / (1 << 20)
    return rows.withColumn("split", F.when(part < share, "validation").otherwise("train"))


def training_rouge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of ROUGE on stems in per cent, to four places, and the mean length of predictions, for each group."""
    t = rows.withColumns({"r": stems.stemmed(stems.words(F.col("reference_summary"))), "g": stems.stemmed(stems.words(F.col("generated_summary")))})
    scored = t.select(*keys, F.size("g").alias("n"), *[v.alias(k) for k, v in stems.rouge(F.col("r"), F.col("g")).items()])
    return scored.groupBy(*keys).agg(*[F.round(F.avg(k), 4).alias(k) for k in ("rouge1", "rouge2", "rougeL")], F.round(F.avg("n"), 4).alias("gen_len"))


def m18_training_rouge(spark, sf_dir):
    return training_rouge(samples(spark, sf_dir), ["language", "model"])


def d9_label_arrays(spark, sf_dir):
    """Labels of whole texts whose words stand for subwords (their place in the alphabet of lengths): cut, closed, padded, masked."""
    ids = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w) + 2)
    d = table(spark, sf_dir, "documents").select("doc_id", stems.truncated(ids, LABEL_TOKENS, END).alias("ids"))
    made = d.select("doc_id", stems.labels(F.col("ids"), LABEL_TOKENS, PAD).alias("labels"), stems.mask(F.col("ids"), LABEL_TOKENS).alias("mask"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return made.select("doc_id", joined("labels"), joined("mask"))


QUERIES = {"m18_training_rouge": m18_training_rouge, "d9_label_arrays": d9_label_arrays}
ORACLE = {
    "d9_label_arrays": f"""WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w) + 2) AS w FROM documents), i AS (SELECT doc_id, w[1:{LABEL_TOKENS - 1}] || [{END}] AS ids FROM t)
SELECT doc_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = {PAD} THEN {stems.IGNORED} ELSE x END) || list_transform(range({LABEL_TOKENS} - len(ids)), lambda x: {stems.IGNORED}), ',') AS labels,
 array_to_string(list_transform(ids, lambda x: 1) || list_transform(range({LABEL_TOKENS} - len(ids)), lambda x: 0), ',') AS mask FROM i""",
}

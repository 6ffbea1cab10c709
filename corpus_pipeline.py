"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens. Each stage's rows are written before the next reads them.

Defined cases, in every stage: an empty table gives an empty table; extra columns of any name are carried to the last
stage but one. Rows of one doc_id are judged each by its own text (quality), are one document of lines, share their
near-dedup verdict, and are mixed row by row. A null doc_id keeps all its lines and is nobody's duplicate. A null or
empty text is one passage of zeros for the classifier, has one empty line and no shingles, weighs 0 words (so the mix takes it
as often as its source's whole share) and has no ids. Null sources are a source; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, line_dedup, minhash, mixing, quality_mil
from newsloom.llm._shared import columns_of, stored, unused

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Trained on the labelled rows of ``docs``."""
    return quality_mil.keep(docs, quality_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has; n_chars follows the text."""
    names = unused(docs, "kept_text", "n_lines", "n_dropped")
    out = line_dedup.LineIndex().insert(docs, line_dedup.BATCHES).apply(docs, names).withColumn("text", F.col(names[0]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8 or more), the one with the smallest id."""
    gone = stored(minhash.near_duplicates(docs, 80).where("not kept").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and digest, and the digest of the text decoded from them."""
    decoded = bpe.decode(bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN), TOKENIZER)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing sources to target weights", mix), ("byte-level BPE", tokens)]

#: The classifier's verdicts and the random copies have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

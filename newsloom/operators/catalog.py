"""Accessors and validity checks over a catalog of sources (C11)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.requests import LANGUAGES

FALLBACK = "en"


@dataclass(frozen=True)
class Catalog:
    """``sources``: source_key, language, topic, country, region. Models by key; the first is the default unless another is named."""

    sources: DataFrame
    models: dict[str, str]
    languages: tuple[str, ...] = LANGUAGES
    default_model_key: str = ""
    default_language_key: str = FALLBACK
    names: dict[str, str] = field(default_factory=dict)

    @property
    def default_model(self) -> str:
        return self.default_model_key if self.default_model_key in self.models else next(iter(self.models), "")

    @property
    def default_language(self) -> str:
        """The configured language, English if it isn't supported."""
        return self.default_language_key if self.default_language_key in self.languages else FALLBACK

    def is_valid_language(self, key: str) -> bool:
        return key in self.languages

    def is_valid_model(self, key: str) -> bool:
        return key in self.models

    def available(self, column: str) -> list[str]:
        """Distinct values of topic, country, region or language that sources have, sorted: a handful, for choices in a form."""
        return [r[0] for r in self.sources.select(column).where(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column).collect()]

    def valid_sources(self) -> DataFrame:
        """source_key and what is wrong with it: no key, a language that isn't supported, no topic, or a key that stands twice."""
        wrong = F.array_compact(
            F.array(
                F.when(F.trim(F.coalesce("source_key", F.lit(""))) == "", "no_key"),
                F.when(~F.coalesce(F.col("language").isin(*self.languages), F.lit(False)), "language"),
                F.when(F.coalesce("topic", F.lit("")) == "", "no_topic"),
                F.when(F.col("n") > 1, "repeated_key"),
            )
        )
        counted = self.sources.groupBy("source_key").agg(F.count("*").alias("n")).withColumnRenamed("source_key", "k")
        return self.sources.join(counted, F.col("source_key").eqNullSafe(F.col("k"))).select("source_key", wrong.alias("wrong"), (F.size(wrong) == 0).alias("valid"))

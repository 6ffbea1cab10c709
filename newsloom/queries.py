"""Registry of the library's queries and of their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import articles, catalog, corpus, evaluation, feed, gather, plots, serving, similarity, training

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

for _module in (serving, feed, evaluation, corpus, catalog, articles, gather, similarity, plots, training):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE

"""Requests and run settings: validated values with clamps, and the Python API that serves them (no web server)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from newsloom.plans import feed, serving
from newsloom.plans.catalog import LOCALES

LANGUAGES = tuple(LOCALES)
NO_FILTER = feed.NO_FILTER


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _filter(text: str) -> str:
    value = " ".join(text.split())
    return "" if value.lower() in NO_FILTER else value


@dataclass(frozen=True)
class FeedRequest:
    """one feed request. A list of sources beats a single one; at most 15 rows for a source."""

    language: str = "en"
    model: str = "model_a"
    limit_per_source: int = 2
    sources: tuple[str, ...] = ()
    topic: str = ""
    country: str = ""
    region: str = ""
    keyword: str = ""
    include_raw: bool = False

    @staticmethod
    def of(args: dict[str, str], models: tuple[str, ...]) -> FeedRequest:
        """From text parameters; ValueError names what is wrong."""
        language, model = args.get("language", "en"), args.get("model", models[0])
        for what, value, allowed in (("language", language, LANGUAGES), ("model", model, models)):
            if value not in allowed:
                raise ValueError(f"invalid {what}: {value}")
        sources = _listed(args.get("sources", "")) or _listed(args.get("source", ""))[:1]
        wanted = args.get("keyword_enabled", "").lower() == "true"
        return FeedRequest(language, model, max(1, min(int(args.get("limit", 2)), 15)), tuple(sources), _filter(args.get("topic", "")), _filter(args.get("country", "")).upper(), _filter(args.get("region", "")), feed.keyword_required(args.get("keyword", "")) if wanted else "", args.get("include_raw", "").lower() == "true")


@dataclass(frozen=True)
class RunSettings:
    """Settings of an ingest run, from environment-like text values."""

    models: tuple[str, ...]
    languages: tuple[str, ...] = LANGUAGES
    sources: tuple[str, ...] = ()
    limit_per_source: int = 50
    fetch_limit_per_source: int = 50
    max_items_per_run: int = 200
    interval_seconds: int = 900
    filters: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(env: dict[str, str], models: tuple[str, ...]) -> RunSettings:
        asked = [x.lower() for x in _listed(env.get("INGEST_LANGUAGES", ""))]
        chosen = list(dict.fromkeys(m for m in _listed(env.get("INGEST_MODELS", "")) if m in models))
        clamp = lambda name, low: max(low, min(int(env.get(name, 50)), 500))
        limit = clamp("INGEST_LIMIT_PER_SOURCE", 1)
        filters = {k: _filter(env.get(f"INGEST_{k.upper()}", "")) for k in ("topic", "country", "region")}
        return RunSettings(
            tuple(chosen) or models, tuple(x for x in asked if x in LANGUAGES) or LANGUAGES, tuple(_listed(env.get("INGEST_SOURCES", ""))), limit, clamp("INGEST_FETCH_LIMIT_PER_SOURCE", limit),
            max(1, int(env.get("INGEST_MAX_ITEMS_PER_RUN", 200))), max(60, int(env.get("INGEST_INTERVAL_SECONDS", 900))), filters | {"country": filters["country"].upper()},
        )


def load_news(items: DataFrame, summaries: DataFrame, request: FeedRequest, catalog_size: int) -> DataFrame:
    """The feed of one request, newest first, with the cap for each source."""
    chosen = feed.filter_items(items, {"topic_key": request.topic, "country_key": request.country, "region_key": request.region}, list(request.sources))
    if request.keyword:
        with_summary = summaries.where(summaries.model_key == request.model)
        hit = feed.like_ascii("title", request.keyword) | feed.like_ascii("summary", request.keyword) | feed.like_ascii("article_text", request.keyword)
        chosen = chosen.join(chosen.join(with_summary.select("news_item_id", "summary"), chosen.id == with_summary.news_item_id).where(hit).select("id"), "id", "left_semi")
    limit = feed.pre_limit(len(request.sources), catalog_size, request.limit_per_source)
    return serving.serve(chosen, summaries, request.model, request.language, limit, request.limit_per_source)

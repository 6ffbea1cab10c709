"""Feeds: RSS 2.0 and Atom documents to entries, and hooks for what needs a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.feed import parse_iso, parse_rfc822

ENTRY = "source_key string, rank int, title string, link string, description string, image_url string, published string"
FIELDS = ("title", "link", "description", "image_url", "published")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _first(item, names: tuple[str, ...]) -> str:
    """Text of the first child of any of the local names, tried in order; '' if none has text."""
    by = {}
    for child in item:
        text = "".join(child.itertext()).strip()
        if text:
            by.setdefault(_local(child.tag), text)
    return next((by[n] for n in names if n in by), "")


def _link(item) -> str:
    """Link text, then Atom links (rel empty or alternate first), then an id that is a URL."""
    text = _first(item, ("link",))
    if text:
        return text
    links = [(c.get("rel", "") not in ("", "alternate"), c.get("href", "").strip()) for c in item if _local(c.tag) == "link"]
    href = next((h for _, h in sorted((x for x in links if x[1]), key=lambda x: x[0])), "")
    if href:
        return href
    own = _first(item, ("guid", "id"))
    return own if own.startswith("http") else ""


def _image(item) -> str:
    """Enclosure, media:content, media:thumbnail (also in a group), then an image inside the description."""
    import re

    nodes = list(item.iter())
    for names in (("enclosure",), ("content",), ("thumbnail",)):
        for c in nodes:
            url, kind = c.get("url", ""), c.get("type", "") or c.get("medium", "")
            if _local(c.tag) in names and url and (kind.startswith("image") or not kind):
                return url
    m = re.search(r"""<img[^>]+src=["']([^"']+)""", _first(item, ("description", "summary", "encoded", "content")), re.I)
    return m[1] if m else ""


def parse_feed(data: bytes) -> list[tuple[str, ...]]:
    """Strict XML first, then without junk before the root, control characters and bare ampersands, then by its tags alone."""
    from xml.etree import ElementTree

    for reader in (ElementTree.fromstring, _mended):
        try:
            return read(reader(data))
        except ElementTree.ParseError:
            continue
    return recovered(data.decode("utf-8", "replace"))


#: One piece of a feed: CDATA, a comment, a tag, or text. Possessive, so reading takes linear time.
PIECE = r"""<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<(?P<shut>/?)(?P<tag>[A-Za-z_][\w:.-]*+)(?P<rest>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|(?P<text>[^<]++)|<"""
READ = frozenset("title link description summary content encoded published updated pubdate date guid id".split())
#: Elements of an entry whose own titles and links aren't the entry's.
OTHERS = frozenset("author contributor source group".split())


def recovered(text: str) -> list[tuple[str, ...]]:
    """S3: entries of a document that no XML reader takes: a field lasts to its own end tag, the next field or the entry's end.

    The link is the link's text, else the href of a link without rel or with rel alternate, else any href, else an id that is a URL.
    The description is summary, description or content, the date published, updated or pubDate. Entries without title or link go.
    """
    import html
    import re

    out: list[tuple[str, ...]] = []
    fields: dict[str, str] | None = None
    links: list[tuple[str, str]] = []
    image, field, parts, inside = "", "", [], ""
    attribute = lambda rest, name: html.unescape(m[2] or m[3] or m[4] or "") if (m := re.search(rf"""\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>/]+))""", rest, re.I)) else ""

    def end_field() -> None:
        nonlocal field
        if field and fields is not None:
            value = " ".join(re.sub(r"<[^>]*>", " ", html.unescape("".join(parts))).split())
            if value:
                fields.setdefault(field, value)
        field = ""
        parts.clear()

    def end_entry() -> None:
        nonlocal fields
        end_field()
        if fields is not None:
            first = lambda *names: next((fields[n] for n in names if n in fields), "")
            href = next((h for rel, h in links if rel in ("", "alternate")), links[0][1] if links else "")
            own = first("guid", "id")
            link = first("link") or href or (own if own.startswith("http") else "")
            if first("title") and link:
                out.append((first("title"), link, first("summary", "description", "content", "encoded"), image, first("published", "updated", "pubdate", "date")))
        fields = None

    for m in re.finditer(PIECE, text, re.S):
        name = (m["tag"] or "").rpartition(":")[2].lower()
        if not name:
            if field and not inside:
                parts.append(html.escape(m["data"]) if m["data"] is not None else m["text"] or "")
        elif name in ("item", "entry"):
            end_entry()
            if not m["shut"]:
                fields, links, image, inside = {}, [], "", ""
        elif fields is None:
            continue
        elif name in OTHERS:
            end_field()
            inside = "" if m["shut"] else inside if m["rest"].endswith("/") else name
        elif m["shut"]:
            if name == field:
                end_field()
        elif not inside and name in READ or name in ("enclosure", "thumbnail", "content") and attribute(m["rest"], "url"):
            if url := attribute(m["rest"], "url") if name in ("enclosure", "thumbnail", "content") else "":
                image = image or url
                continue
            end_field()
            if name == "link" and (href := attribute(m["rest"], "href").strip()):
                links.append((attribute(m["rest"], "rel").lower(), href))
            elif not m["rest"].endswith("/"):
                field = name
    end_entry()
    return out


def _mended(data: bytes):
    """The root of a document with the usual damage taken out."""
    import re
    from xml.etree import ElementTree

    text = data.decode("utf-8", "replace").lstrip("﻿")
    text = text[max(0, text.find("<")) :]
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text)
    return ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))


def read(root) -> list[tuple[str, ...]]:
    items = [x for x in root.iter() if _local(x.tag) in ("item", "entry")]
    return [(_first(x, ("title",)), _link(x), _first(x, ("description", "summary", "content", "encoded")), _image(x), _first(x, ("pubdate", "published", "updated", "date"))) for x in items]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a feed at a time
            found = parse_feed(batch["content"][i].as_py() or b"")
            columns = list(zip(*found, strict=True)) if found else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array([batch["source_key"][i].as_py()] * len(found), pa.string()), pa.array([batch["rank"][i].as_py()] * len(found), pa.int32()), *[pa.array(c, pa.string()) for c in columns]], names=["source_key", "rank", *FIELDS])


def entries(feeds: DataFrame) -> DataFrame:
    """``feeds``: source_key, content (binary), perhaps rank (int). One row for each entry, with published_at."""
    rank = F.col("rank").cast("int") if "rank" in feeds.columns else F.lit(0)
    parsed = feeds.select("source_key", rank.alias("rank"), "content").mapInArrow(_parse, ENTRY)
    return parsed.withColumn("published_at", F.coalesce(parse_rfc822(F.col("published")), parse_iso(F.col("published")))).drop("published")


def newest(found: DataFrame, limit: int) -> DataFrame:
    """Newest first, entries without a date last."""
    return found.orderBy(F.coalesce("published_at", F.timestamp_seconds(F.lit(0))).desc(), "link").limit(limit)


def fetched(sources: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """Hook for live feeds: ``fetch`` gets a URL and returns bytes; the first of ``rss_urls`` that gives any is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [next((b for u in urls or [] if (b := fetch(u))), b"") for urls in batch["rss_urls"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["source_key"], pa.array(found, pa.binary())], names=["source_key", "content"])

    return sources.select("source_key", "rss_urls").mapInArrow(run, "source_key string, content binary")

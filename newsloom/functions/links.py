"""Aggregator links (S8): the publisher's URL inside an article id, and redirects followed to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.storage import Stored

#: The aggregator's host, path words before an id, and the id's first fields (type 19, then a string).
AGGREGATOR = "news.google.com"
ARTICLE_WORDS = ("rss", "articles", "read")
ID_HEAD = "081322"
#: Hosts that are never the publisher.
NOT_PUBLISHERS = ("google.com", "gstatic.com")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def article_id(url: Column) -> Column:
    """The last part of an aggregator's article path; '' for any other URL."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    known = (host(url) == AGGREGATOR) & (F.size(parts) >= 2) & (F.get(parts, F.size(parts) - 2).isin(*ARTICLE_WORDS) | F.array_contains(parts, "articles"))
    return F.when(known, F.get(parts, F.size(parts) - 1)).otherwise("")


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")


def embedded_url(id_: Column) -> Column:
    """The URL in an id: base64 of a message whose first string is it, its length a varint; null if the id holds none."""
    bare = F.regexp_replace(F.translate(id_, "-_", "+/"), "=+$", "")
    data = F.try_to_binary(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    start = len(ID_HEAD) // 2 + 1
    low, high = _byte(data, F.lit(start)), _byte(data, F.lit(start + 1))
    long = low >= 128
    size = F.when(long, (low - 128) + high * 128).otherwise(low)
    text = F.substring(data, F.lit(start + 1) + long.cast("int"), size)
    url = F.when(F.is_valid_utf8(text), text.cast("string"))
    return F.when(F.startswith(F.hex(data), F.lit(ID_HEAD)) & (F.length(text) == size) & url.rlike("^https?://[^/]"), url)


def is_publisher(url: Column) -> Column:
    own = host(url)
    other = own != ""
    for name in NOT_PUBLISHERS:
        other &= ~own.contains(name)
    return other


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """url, end, hops for every url of ``redirects`` (url, target). A url whose chain runs into a cycle ends at itself, after -1 hops.

    Pointers jump to their pointers' pointers, so a chain of n hops takes log2(n) joins. A pointer that is still open when
    jumps are longer than the table has rows is on a cycle or leads to one. Of several targets of a url the smallest holds.
    """
    known = redirects.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("at"))
    ends = Stored(known.select("url", "at", F.lit(1).cast("long").alias("hops")))
    reach, rows = 1, ends.df.count()
    while reach <= rows:
        step = ends.df.select(F.col("url").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        jumped = Stored(ends.df.join(step, "at", "left").select("url", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")))
        ends.drop()
        ends, reach = jumped, reach * 2
        if jumped.df.where("moved").isEmpty():
            break
    open_ = ends.df.join(known.select(F.col("url").alias("at")), "at", "left_semi").select("url", F.lit(True).alias("open"))
    out = ends.df.join(open_, "url", "left")
    return out.select("url", F.when(F.col("open"), F.col("url")).otherwise(F.col("at")).alias("end"), F.when(F.col("open"), -1).otherwise(F.col("hops")).cast("long").alias("hops"))


def resolved(rows: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """``rows`` with ``resolved_url``: for an aggregator's link the URL in its id, else the end of its redirects if that is a publisher's, else
    the link; other links stay."""
    link = F.col(column)
    ours = host(link).contains(AGGREGATOR)
    inside = embedded_url(article_id(link))
    ends = redirect_ends(redirects).select(F.col("url").alias("__url"), "end")
    joined = rows.join(ends, ours & (link == F.col("__url")), "left")
    return joined.withColumn("resolved_url", F.when(ours, F.coalesce(inside, F.when(is_publisher(F.col("end")), F.col("end")), link)).otherwise(link)).drop("__url", "end")

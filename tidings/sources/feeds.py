"""Feed captures (RSS and Atom) as dated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import date_text, free_date
from tidings.functions.text import strip

_TIMES = "pubDate:string,published:string,updated:string,date:string"
_RSS_ITEM = f"struct<title:string,link:string,{_TIMES},`dc:date`:string>"
_ATOM_LINK = "struct<_href:string,_rel:string>"
_ATOM_ENTRY = f"struct<title:string,link:array<{_ATOM_LINK}>,published:string,updated:string>"
FEED = f"struct<channel:struct<item:array<{_RSS_ITEM}>>,item:array<{_RSS_ITEM}>,entry:array<{_ATOM_ENTRY}>>"


def _rss(items: Column) -> Column:
    return F.transform(items, lambda e: F.struct(
        e["title"].alias("title"), e["link"].alias("link"),
        F.coalesce(e["pubDate"], e["published"]).alias("published"),
        F.coalesce(e["updated"], e["dc:date"], e["date"]).alias("updated"),
    ))


def _atom(entries: Column) -> Column:
    def link(e):
        pages = F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.try_element_at(pages, F.lit(1))["_href"], F.try_element_at(e["link"], F.lit(1))["_href"])

    return F.transform(entries, lambda e: F.struct(
        e["title"].alias("title"), link(e).alias("link"),
        e["published"].alias("published"), e["updated"].alias("updated"),
    ))


def feed_items(captures: DataFrame, body: str = "body") -> DataFrame:
    """Feed captures to items with title and link, dated to the day (SC5, XM1, FL6, DT2, DT4).

    Parsing stays in the JVM; a feed that is not XML gives no items.
    """
    keep = [c for c in captures.columns if c != body]
    none = F.array().cast("array<struct<title:string,link:string,published:string,updated:string>>")
    feed = F.from_xml(F.col(body), FEED)
    parsed = captures.select(*keep, feed.alias("_feed"))
    entries = F.concat(
        F.coalesce(_rss(F.col("_feed.channel.item")), none),
        F.coalesce(_rss(F.col("_feed.item")), none),
        F.coalesce(_atom(F.col("_feed.entry")), none),
    )
    return (
        parsed.select(*keep, F.posexplode(entries).alias("pos", "_entry"))
        .select(
            *keep, "pos", strip(F.col("_entry.title")).alias("title"), F.col("_entry.link").alias("item_url"),
            date_text(F.col("_entry.published")).alias("_published"), date_text(F.col("_entry.updated")).alias("_updated"),
        )
        .filter((F.col("title") != "") & (F.col("item_url") != ""))
        .select(
            *keep, "pos", "title", "item_url",
            F.date_trunc("day", F.coalesce(free_date(F.col("_published")), free_date(F.col("_updated")))).alias("published_at"),
        )
    )

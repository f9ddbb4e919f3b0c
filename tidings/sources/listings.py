"""Which captures a listing run expects, and the items found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import MAX_PAGES, RNS_HOST
from tidings.functions.urls import list_url
from tidings.operators.pages import ir_listing
from tidings.sources.captures import at_addresses
from tidings.sources.feeds import feed_items


def expected_list_pages(epics: DataFrame, max_pages: int = MAX_PAGES, host: str = RNS_HOST) -> DataFrame:
    """One row per (epic, page_no) with the page's address (SC10, LM1)."""
    numbered = epics.select("epic", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page_no"))
    return numbered.withColumn("url", list_url(F.col("epic"), F.col("page_no"), host))


def list_page_captures(epics: DataFrame, captures: DataFrame, max_pages: int = MAX_PAGES, host: str = RNS_HOST) -> DataFrame:
    """Captures of the expected list pages, with ``page_no`` and the columns of ``epics`` (SC10).

    Issuer and page stand in the address, so it is settled on addresses alone which
    pages are asked for. Of several captures of a page, or of a part of it told
    apart by ``block``, the newest is read.
    """
    inside = "^" + host.replace(".", r"\.") + r"/stock/([^/]+)/company-news\?page=(\d+)$"
    listed = captures.select("url").where(F.col("url").rlike(inside)).distinct().withColumn(
        "epic", F.regexp_extract("url", inside, 1)).withColumn("page_no", F.regexp_extract("url", inside, 2).cast("int"))
    wanted = listed.where(F.col("page_no").between(1, max_pages)).join(epics, "epic")
    return at_addresses(wanted, captures, parts=("block",) if "block" in captures.columns else ())


def ir_items(issuers: DataFrame, captures: DataFrame) -> DataFrame:
    """Items of each issuer's feed, then of its page (JN7, ST3).

    ``issuers`` has ``issuer_id, rss, page, item_selector, date_selector``.
    ``part`` is 0 for the feed and 1 for the page; with ``pos`` it is the order
    within an issuer. Of several captures of a feed or page the newest is read.
    """
    feeds = at_addresses(issuers.filter(F.col("rss") != "").select("issuer_id", F.col("rss").alias("url")), captures.filter(F.col("status") < 400))
    pages = at_addresses(issuers.filter(F.col("page") != "").select(
        "issuer_id", "item_selector", "date_selector", F.col("page").alias("url")), captures)
    shown = ("issuer_id", "part", "pos", "item_url", "title", "published_at")
    from_feeds = feed_items(feeds.select("issuer_id", "body")).withColumn("part", F.lit(0)).select(*shown)
    from_pages = ir_listing(pages, "item_selector", "date_selector").withColumn("part", F.lit(1)).select(*shown)
    return from_feeds.unionByName(from_pages)

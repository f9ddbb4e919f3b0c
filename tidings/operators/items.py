"""Items found by the sources: screening, first-wins, paging, ledger.

An item has ``source, source_rank, item_idx, epic, page_no, url, title,
published_at``. Rows have no order in Spark, so rank and index are columns and
decide every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.fixed_values import IR_KEYWORDS, MAX_PAGES, RNS_KEYWORDS, SOURCE_RANK
from tidings.functions.dates import cutoff
from tidings.operators.joins import first_per_key, hot_key_join
from tidings.operators.pages import detail_dates, fetched
from tidings.sources.captures import at_addresses


# -- validity ------------------------------------------------------------
def valid_items(items: DataFrame) -> DataFrame:
    """Items with an address; a missing title becomes empty (SK3)."""
    return items.filter(F.col("url") != "").withColumn("title", F.coalesce("title", F.lit("")))


def quarantined_items(items: DataFrame) -> DataFrame:
    """The complement of :func:`valid_items`, with the reason (SK3)."""
    return items.filter(F.coalesce(F.col("url") == "", F.lit(True))).withColumn("reason", F.lit("empty url"))


def counted(items: DataFrame, observation) -> DataFrame:
    """Count good and malformed items while they pass, without another job."""
    bad = F.coalesce(F.col("url") == "", F.lit(True))
    return items.observe(
        observation, F.count_if(~bad).alias("valid"), F.count_if(bad).alias("malformed"))


# -- screening -----------------------------------------------------------
def matches(title: Column, keywords: str) -> Column:
    return F.coalesce(title, F.lit("")).rlike(f"(?i)({keywords})")


def rns_titles(items: DataFrame, keywords: str = RNS_KEYWORDS) -> DataFrame:
    """Items whose title has a London keyword (FL4, UD2)."""
    return items.filter(matches(F.col("title"), keywords))


def ir_titles(items: DataFrame, keywords: str = IR_KEYWORDS) -> DataFrame:
    """Items whose title has an IR keyword (FL5, UD2)."""
    return items.filter(matches(F.col("title"), keywords))


def in_window(items: DataFrame, as_of, days: int) -> DataFrame:
    """Items not older than the lookback; undated ones stay (FL3, IN4)."""
    return items.filter(F.col("published_at").isNull() | (F.col("published_at") >= cutoff(as_of, days)))


def enabled(items: DataFrame, sources) -> DataFrame:
    """Items of the sources switched on (FL9)."""
    return items.filter(F.col("source").isin(*sources)) if sources else items.filter(F.lit(False))


# -- union and first wins --------------------------------------------------
def with_rank(items: DataFrame) -> DataFrame:
    """Precedence of each item's source as ``source_rank``."""
    rank = F.create_map(*[F.lit(x) for pair in SOURCE_RANK.items() for x in pair])
    return items.withColumn("source_rank", F.try_element_at(rank, F.col("source")))


def first_source_wins(items: DataFrame) -> DataFrame:
    """Each address once: the earliest source, then the earliest item (ST1, WN1)."""
    return first_per_key(items, ["url"], ["source_rank", "item_idx"])


def unseen(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items whose address is not in the ledger (JN4, ST4).

    Repeated keys of the ledger are collapsed in its scan, before the shuffle.
    """
    return items.join(ledger.select("url").distinct(), "url", "left_anti")


# -- paging ----------------------------------------------------------------
def read_pages(list_pages: DataFrame, items: DataFrame, as_of, days: int, max_pages: int = MAX_PAGES) -> DataFrame:
    """List pages (epic, page_no) that paging reaches (AG6, WN2, LM1).

    ``list_pages`` has ``epic, page_no, status``. An empty page, or a page whose
    items are all dated and older than the lookback, is the last one read; a
    page that failed is passed over. Items are aggregated to one row per page
    before anything else, and a window then runs over those few page rows.
    """
    newest = items.groupBy("epic", "page_no").agg(
        F.max("published_at").alias("newest"),
        F.count("*").alias("n_items"),
        F.count("published_at").alias("n_dated"),
    )
    pages = list_pages.filter((F.col("status") < 400) & (F.col("page_no") <= max_pages))
    stops = F.col("n_items").isNull() | (
        (F.col("n_dated") == F.col("n_items")) & (F.col("newest") < cutoff(as_of, days)))
    before = Window.partitionBy("epic").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pages.join(newest, ["epic", "page_no"], "left")
        .withColumn("_stops", stops.cast("int"))
        .withColumn("_stopped", F.sum("_stops").over(before))
        .filter(F.coalesce("_stopped", F.lit(0)) == 0)
        .select("epic", "page_no")
    )


def paged_items(list_pages: DataFrame, items: DataFrame, as_of, days: int, max_pages: int = MAX_PAGES) -> DataFrame:
    """Items of the list pages that paging reaches."""
    reached = read_pages(list_pages, items, as_of, days, max_pages)
    return hot_key_join(
        items.filter(F.col("page_no") <= max_pages), reached, ["epic", "page_no"], "left_semi", by=["item_idx"])


# -- dates from article pages ------------------------------------------------
def with_detail_dates(items: DataFrame, captures: DataFrame, keywords: str = RNS_KEYWORDS) -> DataFrame:
    """Fill missing dates of keyword items from their own pages (JN3).

    Only the addresses that need it are looked up, each once, so a page shared
    by many items is parsed once, in its newest capture. Dated items take no part
    in the join.
    """
    needs = F.col("published_at").isNull() & matches(F.col("title"), keywords)
    undated = items.filter(needs)
    dates = detail_dates(at_addresses(undated.select("url").distinct(), fetched(captures)))
    filled = hot_key_join(undated, dates, ["url"], "left", by=["item_idx"]).select(
        *[F.col("detail_at").alias("published_at") if c == "published_at" else F.col(c) for c in items.columns])
    return items.filter(~needs).unionByName(filled)

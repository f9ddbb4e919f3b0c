"""The three sources, from landed captures to items (UD1).

Each gives ``source, source_rank, item_idx, epic, page_no, url, title,
published_at``. ``item_idx`` says where an item stands (issuer position, part,
page, block, place), so it is the same in every run and needs no numbering over
all rows. What is parsed is a table before it is screened, joined and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import FORMS, IR_KEYWORDS, LOOKBACK_DAYS, MAX_PAGES, RNS_HOST, RNS_KEYWORDS, SOURCE_RANK
from tidings.functions.dates import filing_date
from tidings.functions.text import blank_to_null
from tidings.operators.filings import filed_in_window, filing_title, resolved_issuers, unique_issuers, with_document, with_forms, with_issuer
from tidings.operators.items import in_window, ir_titles, paged_items, rns_titles, with_detail_dates
from tidings.operators.pages import rns_listing
from tidings.session import stage
from tidings.sources.filings import filings
from tidings.sources.listings import ir_items, list_page_captures


#: Type of ``item_idx``; its fields are compared in turn.
INDEX = "struct<issuer:bigint,part:int,page:int,block:bigint,place:bigint>"


def item_index(issuer: str, part: str | int, page: str | int, block: str | int, place: str) -> Column:
    """Where an item stands."""
    return F.struct(*(F.col(c) if isinstance(c, str) else F.lit(c) for c in (issuer, part, page, block, place))).cast(INDEX)


def _named(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(
        F.lit(source).alias("source"), F.lit(SOURCE_RANK[source]).alias("source_rank"), "item_idx", "epic", "page_no", "url", "title", "published_at")


def edgar_items(submissions: DataFrame, issuers: DataFrame, ticker_map: DataFrame, captures: DataFrame, as_of,
                days: int = LOOKBACK_DAYS, forms=FORMS) -> DataFrame:
    """Filings of the issuers in form and window, with the document to read (SC2 -> FL1 -> FL2 -> JN6 -> JN2).

    ``submissions`` has ``cik10, block, body`` (``block``: which of an issuer's
    documents); ``issuers`` has ``position, name, ticker, cik``.
    """
    known = resolved_issuers(unique_issuers(issuers), ticker_map)
    wanted = stage(filed_in_window(with_forms(filings(submissions), forms), as_of, days), "filings")
    chosen = with_document(with_issuer(wanted, known), captures)
    return _named(chosen.select(
        item_index("position", 0, 0, "block", "pos").alias("item_idx"),
        F.coalesce(blank_to_null(F.col("ticker")), F.col("name")).alias("epic"), F.lit(1).alias("page_no"), "url",
        filing_title().alias("title"), filing_date(F.col("filing_date")).alias("published_at")), "edgar")


def london_items(epics: DataFrame, captures: DataFrame, as_of, days: int = LOOKBACK_DAYS, keywords: str = RNS_KEYWORDS,
                 max_pages: int = MAX_PAGES, host: str = RNS_HOST) -> DataFrame:
    """News of the list pages that paging reaches, screened and dated (SC10 -> SC6 -> WN2 -> FL4 -> JN3 -> FL3).

    ``epics`` has ``position, epic``. ``captures`` holds list pages and article
    pages; a list page may be landed in several parts, told apart by ``block``.
    """
    if "block" not in captures.columns:
        captures = captures.withColumn("block", F.lit(0))
    pages = list_page_captures(epics, captures, max_pages, host)
    found = stage(rns_listing(pages).select(
        item_index("position", 0, "page_no", "block", "pos").alias("item_idx"),
        "epic", "page_no", F.col("item_url").alias("url"), "title", "published_at"), "list-items")
    listed = pages.groupBy("epic", "page_no").agg(F.min("status").alias("status"))
    reached = stage(rns_titles(paged_items(listed, found, as_of, days, max_pages), keywords), "reached-items")
    dated = with_detail_dates(reached, captures.drop("block"), keywords)
    return _named(in_window(dated, as_of, days), "lse")


def investor_items(issuers: DataFrame, captures: DataFrame, as_of, days: int = LOOKBACK_DAYS, keywords: str = IR_KEYWORDS) -> DataFrame:
    """Entries of the issuers' feeds, then of their pages, screened (JN7 -> FL5 -> FL3).

    ``issuers`` has ``issuer_id, epic, rss, page, item_selector, date_selector``.
    """
    parsed = stage(ir_titles(ir_items(issuers, captures), keywords), "entries")
    found = parsed.join(issuers.select("issuer_id", "epic"), "issuer_id").select(
        item_index("issuer_id", "part", 0, 0, "pos").alias("item_idx"), "epic", F.lit(1).alias("page_no"),
        F.col("item_url").alias("url"), "title", "published_at")
    return _named(in_window(found, as_of, days), "ir")

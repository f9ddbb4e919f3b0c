"""HTML jobs: cleaning, titles and list extraction over captures.

Each is one narrow pass over the captures. Only the body (and the few columns a
job needs) goes to Python in Arrow batches; everything else stays in the JVM.
Dates and hosts are read on the way back with built-in expressions.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import IR_DATE_CLASS, IR_ITEM_SELECTORS, JUNK_SELECTORS, RNS_HOST
from tidings.functions import markup
from tidings.functions.dates import date_text, free_date, listed_date
from tidings.functions.text import blank_to_null, decode_entities, strip
from tidings.functions.urls import host_url

_RNS_PAGE = "struct<texts:array<string>,items:array<struct<href:string,title:string,date:int>>>"
_IR_PAGE = ("struct<texts:array<string>,"
            "items:array<struct<selector_rank:int,url:string,title:string,resolved:boolean,dates:array<int>>>>")


def fetched(captures: DataFrame) -> DataFrame:
    """Captures that count as fetched: status below 400."""
    return captures.filter(F.col("status") < 400)


def is_pdf() -> Column:
    return F.lower("content_type").contains("application/pdf") | F.lower("final_url").endswith(".pdf")


def html_captures(captures: DataFrame) -> DataFrame:
    """Fetched captures that hold HTML; see :func:`pdf_captures` for the rest (SC8)."""
    return fetched(captures).filter(~F.coalesce(is_pdf(), F.lit(False)))


def pdf_captures(captures: DataFrame) -> DataFrame:
    """Fetched captures that are PDFs: documents without a readable text (SC8)."""
    return fetched(captures).filter(is_pdf())


def with_page_title(captures: DataFrame, body: str = "body") -> DataFrame:
    """Replace the body by ``title_html``: the first ``<title>``, read without parsing the page (TX2)."""
    keep = [c for c in captures.columns if c != body]
    inner = F.regexp_extract(body, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return (
        captures.select(*keep, inner.alias("_title"))
        .select(*keep, strip(decode_entities(F.col("_title"))).alias("_title"))
        .select(*keep, blank_to_null(F.col("_title")).alias("title_html"))
    )


def headline(title_hint: Column, title_html: Column, url: Column) -> Column:
    """Title hint, else page title, else address; empty counts as missing (PJ4)."""
    return F.coalesce(blank_to_null(title_hint), blank_to_null(title_html), url)


def documents(captures: DataFrame, junk=JUNK_SELECTORS, pdfs: bool = False) -> DataFrame:
    """HTML captures to ``title_html`` and cleaned ``text`` (TX1, TX2, TX3, TX4, UD4).

    The body column is replaced; all other columns are kept. With ``pdfs`` PDFs
    stay, without a title and with an empty text (SC8).
    """
    junk_texts = tuple(junk)

    @F.pandas_udf("title_html string, text string")
    def clean(bodies: pd.Series) -> pd.DataFrame:
        drop = markup.selectors(junk_texts)
        rows = []
        for body in bodies:
            page = markup.Page(body or "")
            rows.append((page.title(), page.visible_text(drop)))
        return pd.DataFrame(rows, columns=["title_html", "text"])

    keep = [c for c in captures.columns if c != "body"]
    # The bytes of a PDF stay where they are.
    readable = F.when(~F.coalesce(is_pdf(), F.lit(False)), F.col("body"))
    rows = fetched(captures).withColumn("body", readable) if pdfs else html_captures(captures)
    return (
        rows
        .select(*keep, clean("body").alias("_clean"))
        .select(*keep, "_clean.title_html", "_clean.text")
    )


def rns_listing(captures: DataFrame, host: str = RNS_HOST) -> DataFrame:
    """List pages to dated items (SC6, FL6, FL7, DT1, TX14).

    ``captures`` carries ``epic`` beside the body; a page without one has no items
    and is listed by :func:`unreadable_list_pages`. One row per anchor, with its
    position on the page in ``pos``. Date texts leave Python once per page and are
    read there. (An outer explode keeps the optimizer from
    asking for the size of the items first, which would parse each page twice.)
    """

    @F.pandas_udf(_RNS_PAGE)
    def items(bodies: pd.Series, epics: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([markup.rns_items(b or "", e) for b, e in zip(bodies, epics)], columns=["texts", "items"])

    keep = [c for c in captures.columns if c != "body"]
    return (
        fetched(captures)
        .select(*keep, items("body", "epic").alias("_page"))
        .select(*keep, "_page.items", F.transform("_page.texts", listed_date).alias("_dates"))
        .select(*keep, F.posexplode_outer(F.transform("items", lambda i: F.struct(
            host_url(i["href"], host).alias("item_url"), i["title"].alias("title"), F.get("_dates", i["date"]).alias("published_at"),
        ))).alias("pos", "_item")).where("pos is not null")
        .select(*keep, "pos", "_item.*")
    )


def ir_listing(captures: DataFrame, item_selector: str | None = None, date_selector: str | None = None) -> DataFrame:
    """IR pages to dated items (SC7, AG3, TX15, DT2, DT4, UD5, UD6).

    ``item_selector`` and ``date_selector`` name columns of ``captures`` that
    hold an issuer's own selectors. An address counts once per page, for the
    first selector that finds it; that is settled inside the page, so no
    shuffle is needed. Date texts leave Python once per page and are read there
    once, before the page is taken apart into items. ``quarantine`` says what is
    wrong with an item that is kept all the same.
    """
    own_item = F.col(item_selector) if item_selector else F.lit(None).cast("string")
    own_date = F.col(date_selector) if date_selector else F.lit(None).cast("string")

    @F.pandas_udf(_IR_PAGE)
    def items(bodies: pd.Series, bases: pd.Series, firsts: pd.Series, dates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([
            markup.ir_items(
                body or "", base, ((first,) if first else ()) + IR_ITEM_SELECTORS, date, IR_DATE_CLASS, urljoin)
            for body, base, first, date in zip(bodies, bases, firsts, dates)
        ], columns=["texts", "items"])

    keep = [c for c in captures.columns if c != "body"]
    return (
        fetched(captures)
        .select(*keep, items("body", "final_url", own_item, own_date).alias("_page"))
        .select(*keep, "_page.items", F.transform(F.transform("_page.texts", date_text), free_date).alias("_dates"))
        .select(*keep, F.posexplode_outer(F.transform("items", lambda i: F.struct(
            i["selector_rank"].alias("selector_rank"), i["url"].alias("item_url"), i["title"].alias("title"),
            F.get(F.filter(F.transform(i["dates"], lambda d: F.get("_dates", d)), lambda d: d.isNotNull()), F.lit(0)).alias("published_at"),
            F.when(~i["resolved"], "address not resolved").alias("quarantine"),
        ))).alias("pos", "_item")).where("pos is not null")
        .select(*keep, "pos", "_item.*")
    )


def unreadable_list_pages(captures: DataFrame) -> DataFrame:
    """Fetched list pages that :func:`rns_listing` cannot read, with the ``reason`` (IN6)."""
    return fetched(captures).where(F.coalesce("epic", F.lit("")) == "").drop("body").withColumn("reason", F.lit("no epic"))


def detail_dates(captures: DataFrame) -> DataFrame:
    """Publication date on an article's own page; null if unreadable (SC9)."""

    @F.pandas_udf("string")
    def date_text(bodies: pd.Series) -> pd.Series:
        return bodies.map(markup.detail_date_text, na_action="ignore")

    return fetched(captures).select("url", listed_date(date_text("body")).alias("detail_at"))

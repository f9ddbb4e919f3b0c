"""Captures rendered from the given tables: JSON, XML and HTML documents.

A document never gathers an unbounded group: rows are put together per block of
consecutive keys, and keys are unique, so the block size bounds every document
whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.urls import list_url
from workload.tables import table

BLOCK = 200


def _block(key: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(key) / size)


def _in_order(key: str, *columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(key, *columns)))


def ticker_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker directory JSON documents, one per block of tickers; one entry in ten comes twice."""
    rows = table(spark, sf_dir, "ticker_map").select("ticker_key", "cik10", F.col("cik10").cast("bigint").alias("cik_str"))
    twice = F.when(F.col("cik_str") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    entries = rows.select("*", F.explode(twice).alias("version")).select(
        "cik_str", "version",
        F.struct(
            # An outdated number first; the entry after it is the right one.
            F.when(F.col("version") == 0, F.col("cik_str") + 5_000_000).otherwise(F.col("cik_str")).alias("cik_str"),
            F.upper("ticker_key").alias("ticker"),
        ).alias("entry"),
    )
    listed = entries.groupBy(_block("cik_str").alias("directory_id")).agg(
        _in_order("cik_str", "version", "entry").alias("_rows"))
    keyed = F.transform("_rows", lambda r, i: F.struct(i.cast("string").alias("key"), r["entry"].alias("value")))
    return listed.select("directory_id", F.to_json(F.map_from_entries(keyed)).alias("body"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions JSON per issuer and block of filings; in every second block one array is short."""
    rows = table(spark, sf_dir, "filings")
    grouped = rows.groupBy("cik10", _block("filing_id", 1000).alias("block")).agg(
        _in_order("filing_id", "form", "filing_date", "accession", "primary_doc").alias("_rows"))
    kept = F.size("_rows") - (F.col("block") % 2).cast("int")
    recent = F.struct(
        F.col("_rows.form").alias("form"), F.col("_rows.filing_date").alias("filingDate"),
        F.col("_rows.accession").alias("accessionNumber"),
        F.slice("_rows.primary_doc", F.lit(1), kept).alias("primaryDocument"),
    )
    return grouped.select("cik10", "block", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))


def feed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS 2.0 documents per issuer and block of items; Atom for every third issuer."""
    items = table(spark, sf_dir, "news_items")
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(
        F.lit("<item><title>"), F.col("title"), F.lit("</title><link>"), F.col("url"), F.lit("</link>"),
        F.when(F.col("item_idx") % 2 == 0, F.concat(F.lit("<pubDate>"), stamp, F.lit(" GMT</pubDate>")))
        .when(F.col("item_idx") % 2 == 1, F.concat(F.lit("<dc:date>"), iso, F.lit("</dc:date>"))), F.lit("</item>"))
    atom = F.concat(
        F.lit("<entry><title>"), F.col("title"), F.lit('</title><link rel="alternate" href="'), F.col("url"), F.lit('"/>'),
        F.concat(F.lit("<updated>"), iso, F.lit("</updated>")), F.lit("</entry>"))

    def without_date(start, end):
        return F.concat(F.lit(start + "<title>"), F.col("title"), end)

    undated_rss = without_date("<item>", F.concat(F.lit("</title><link>"), F.col("url"), F.lit("</link></item>")))
    undated_atom = without_date("<entry>", F.concat(F.lit('</title><link rel="alternate" href="'), F.col("url"), F.lit('"/></entry>')))
    is_atom = F.substring("epic", 2, 20).cast("bigint") % 3 == 0
    entry = F.when(is_atom, F.coalesce(atom, undated_atom)).otherwise(F.coalesce(rss, undated_rss))
    grouped = items.select("epic", "item_idx", is_atom.alias("is_atom"), entry.alias("entry")).groupBy(
        "epic", "is_atom", _block("item_idx").alias("block")).agg(_in_order("item_idx", "entry").alias("_rows"))
    entries = F.array_join("_rows.entry", "")
    body = F.when(
        F.col("is_atom"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>News</title>'), entries, F.lit("</feed>"))
    ).otherwise(F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>News</title>'),
        entries, F.lit("</channel></rss>")))
    return grouped.select("epic", "block", body.alias("body"))


def list_pages(spark: SparkSession, sf_dir: str, max_pages: int) -> DataFrame:
    """Expected list pages with a status; a few fetches failed."""
    users = table(spark, sf_dir, "event_times").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("epic"),
        F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page_no"), "user_id",
    ).select("epic", "page_no", F.when((F.col("user_id") + F.col("page_no")) % 17 == 0, 404).otherwise(200).alias("status"))


def list_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News list HTML per issuer, page and block of items.

    Each card sits in wrappers of its own, so an undated one has no other
    card's date near it; every card is followed by an anchor of another issuer.
    """
    items = table(spark, sf_dir, "news_items").filter("source = 'lse'")
    name = F.when(F.col("item_idx") % 2 == 0, F.lower("epic")).otherwise(F.col("epic"))
    host = F.when(F.col("item_idx") % 5 == 0, F.lit("https://www.londonstockexchange.com")).otherwise(F.lit(""))
    shown = (
        F.when(F.col("item_idx") % 3 == 0, F.concat(
            F.lit('<time datetime="'), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('">x</time>')))
        .when(F.col("item_idx") % 3 == 1, F.concat(
            F.lit("<time>"), F.date_format("published_at", "dd MMM yyyy HH:mm"), F.lit("</time>")))
        .otherwise(F.concat(
            F.lit('<span class="news-date">'), F.date_format("published_at", "dd MMM yyyy"), F.lit("</span>")))
    )
    card = F.concat(
        F.lit("<li><div><div><div><div><a href=\""), host, F.lit("/news-article/"), name, F.lit("/"),
        F.col("item_idx").cast("string"), F.lit("\"> "), F.col("title"), F.lit(" </a>"), F.coalesce(shown, F.lit("")),
        F.lit('</div></div></div></div><p><a href="/news-article/OTHER/1">Other results</a></li>'))
    grouped = items.select("epic", "page_no", "item_idx", card.alias("card")).groupBy(
        "epic", "page_no", _block("item_idx").alias("block")).agg(_in_order("item_idx", "card").alias("_rows"))
    body = F.concat(F.lit("<html><body><ul>"), F.array_join("_rows.card", "\n"), F.lit("</ul>"))
    return grouped.select(
        list_url(F.col("epic"), F.col("page_no")).alias("url"), "block", F.lit(200).alias("status"), body.alias("body"))


def detail_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article page per address, dated by its first event; a few fetches failed."""
    first = table(spark, sf_dir, "event_times").groupBy("url").agg(
        F.min("ts").alias("ts"), F.min("event_id").alias("first_id"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("first_id") % 2 == 0, F.concat(
        F.lit("<html><head><title>a</title></head><body><p><time>"), F.date_format("ts", "dd MMM yyyy HH:mm"), F.lit("</time>"))
    ).otherwise(F.concat(
        F.lit('<html><head><meta property="article:published_time" content="'), stamp, F.lit('"></head><body><p>a')))
    return first.select("url", F.when(F.col("first_id") % 13 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


def _articles(rows: DataFrame) -> DataFrame:
    """Results pages for ``url, k``, with figures that follow from ``k``; a few fetches failed."""
    k = F.col("k")
    body = F.concat(
        F.lit("<html><head><title>Notice "), k.cast("string"), F.lit("</title></head><body><nav>Revenue $9.9 bn</nav><article><p>Q"),
        (k % 4 + 1).cast("string"), F.lit(" 2023 revenue was $"), (k % 900 + 1).cast("string"),
        F.lit(".5 million, prior year up "), (k % 60).cast("string"), F.lit(".2%.</p><p>The outlook is stable.</p></article></body></html>"))
    return rows.select(
        "url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"),
        F.when(k % 13 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


def article_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results page per address of the news."""
    return _articles(table(spark, sf_dir, "event_times").groupBy("url").agg(F.min("event_id").alias("k")))


def _london_address() -> Column:
    name = F.when(F.col("item_idx") % 2 == 0, F.lower("epic")).otherwise(F.col("epic"))
    return F.concat(F.lit("https://www.londonstockexchange.com/news-article/"), name, F.lit("/"), F.col("item_idx").cast("string"))


def london_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results page per item of the London lists."""
    items = table(spark, sf_dir, "news_items").filter("source = 'lse'")
    return _articles(items.select(_london_address().alias("url"), F.col("item_idx").alias("k")))


def filing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results page per primary document of a filing."""
    named = table(spark, sf_dir, "primary_captures").select("url")
    return _articles(named.withColumn("k", F.regexp_extract("url", r"/d(\d+)\.htm$", 1).cast("bigint")))


def wire_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated RSS per issuer and block that points to a fifth of the London items."""
    items = table(spark, sf_dir, "news_items").filter("source = 'lse' AND item_idx % 5 = 1")
    entry = F.concat(F.lit("<item><title>"), F.col("title"), F.lit("</title><link>"), _london_address(), F.lit("</link></item>"))
    grouped = items.select("epic", "item_idx", entry.alias("entry")).groupBy("epic", _block("item_idx").alias("block")).agg(
        _in_order("item_idx", "entry").alias("_rows"))
    body = F.concat(F.lit('<rss version="2.0"><channel><title>Wire</title>'), F.array_join("_rows.entry", ""), F.lit("</channel></rss>"))
    return grouped.select("epic", "block", body.alias("body"))


def selector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer pages that need selectors of their own, per issuer and block of items.

    Every item stands in a wrapper of its own and is followed by an element of the
    issuer's date class, which names no date for two items in three; one of these
    has a ``<time>`` in its wrapper, and the page's own date stands for all others.
    Behind the items a list repeats some and adds further ones.
    """
    items = table(spark, sf_dir, "news_items").filter("source = 'ir'")
    idx, which = F.col("item_idx").cast("string"), F.col("item_idx") % 3
    when = F.when(which == 0, F.coalesce(F.date_format("published_at", "dd MMM yyyy"), F.lit(""))).otherwise("soon")
    time = F.when(which == 1, F.concat(F.lit('<time datetime="'), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"></time>')))
    card = F.concat(
        F.lit('<section><div><div class="deal"><a class="own" href="/n/'), idx, F.lit('">'), F.col("title"), F.lit("</a>"), F.coalesce(time, F.lit("")),
        F.lit('<b class="when">'), when, F.lit("</b></div></div></section>"))
    listed = F.when(F.col("item_idx") % 4 == 0, F.concat(F.lit('<li><a href="/n/'), idx, F.lit('">Again</a></li>'))).when(
        F.col("item_idx") % 4 == 1, F.concat(F.lit('<li><a href="/extra/'), idx, F.lit('">Extra</a></li>')))
    grouped = items.select("epic", "item_idx", card.alias("card"), F.coalesce(listed, F.lit("")).alias("listed")).groupBy(
        "epic", _block("item_idx").alias("block")).agg(_in_order("item_idx", "card", "listed").alias("_rows"))
    body = F.concat(
        F.lit('<html><head><meta property="article:published_time" content="2024-01-15T08:00:00Z"></head><body>'), F.array_join("_rows.card", ""),
        F.lit("<div><div><ul>"), F.array_join("_rows.listed", ""), F.lit("</ul></div></div>"))
    even = F.substring("epic", 2, 20).cast("bigint") % 2 == 0
    return grouped.select(
        "epic", F.concat_ws("/", F.lit("https://ir.example.com/list"), "epic", "block").alias("final_url"), F.lit(200).alias("status"), body.alias("body"),
        F.when(even, ".deal a").otherwise("a.own").alias("item_selector"), F.when(even, ".when").otherwise("b.when").alias("date_selector"))


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger documents in the three landed formats; one user has at most 37 addresses."""
    rows = table(spark, sf_dir, "seen_rows").distinct()
    grouped = rows.groupBy("user_id").agg(F.sort_array(F.collect_list("url")).alias("keys"))
    form = F.floor(F.col("user_id") / 9) % 3
    value = (
        F.when(form == 0, F.to_json("keys"))
        .when(form == 1, F.to_json(F.struct(F.col("keys").alias("seen"))))
        .otherwise(F.concat(F.array_join("keys", "\n"), F.lit("\n\n")))
    )
    return grouped.select("user_id", value.alias("value"))

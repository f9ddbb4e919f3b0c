"""Filings: issuers and their numbers, form and date filters, document choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import ARCHIVE_ROOT, EXHIBIT_LINK, FORMS, ITEM_202
from tidings.functions.dates import cutoff, filing_date
from tidings.functions.text import blank_to_null, first_match
from tidings.functions.urls import archive_folder, archive_key, index_url, join_url, pad_cik, primary_url
from tidings.operators.joins import first_per_key, hot_key_join


# -- issuers ---------------------------------------------------------------
def unique_issuers(issuers: DataFrame, position: str = "position") -> DataFrame:
    """Each issuer once, first wins; the key is the number, else the ticker (AG1).

    Issuers with neither are dropped. One listed by number and again by ticker
    stays twice and falls together later, when addresses are made unique.
    """
    number = blank_to_null(F.col("cik").cast("string"))
    key = F.coalesce(F.when(number != "0", number), blank_to_null(F.lower("ticker")))
    keyed = issuers.withColumn("_key", key).filter(F.col("_key").isNotNull())
    return first_per_key(keyed, ["_key"], [position]).drop("_key")


def resolved_issuers(issuers: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Issuers with a ten-digit number in ``cik10`` (JN1, FL10).

    Only issuers without a number are looked up by ticker, so numbered ones and
    empty tickers add no rows to one join key. What stays unknown is dropped.
    """
    given = pad_cik(F.nullif(F.col("cik").cast("string"), F.lit("0")))
    known = issuers.withColumn("cik10", given)
    looked_up = (
        known.filter(F.col("cik10").isNull() & (F.col("ticker") != ""))
        .drop("cik10")
        .withColumn("ticker_key", F.lower("ticker"))
        .join(ticker_map.select("ticker_key", "cik10"), "ticker_key")
        .drop("ticker_key")
    )
    return known.filter(F.col("cik10").isNotNull()).unionByName(looked_up)


def with_issuer(filings: DataFrame, issuers: DataFrame) -> DataFrame:
    """Filings joined to their issuer on the normalised number (JN6).

    One issuer may have a large share of all filings; ``accession`` tells its
    rows apart.
    """
    columns = [c for c in ("cik10", "name", "ticker", "position") if c in issuers.columns]
    return hot_key_join(filings, issuers.select(*columns), ["cik10"], "inner", by=["accession"])


# -- filters ---------------------------------------------------------------
def with_forms(filings: DataFrame, forms=FORMS) -> DataFrame:
    """Filings of the wanted forms, compared exactly (FL1, UD3)."""
    return filings.filter(F.col("form").isin(*forms))


def override_forms(text: str) -> tuple[str, ...]:
    """A comma list of forms, upper-cased (UD3)."""
    return tuple(f.strip().upper() for f in text.split(",") if f.strip())


def filed_in_window(filings: DataFrame, as_of, days: int) -> DataFrame:
    """Filings with a readable date inside the lookback (FL2, DT3)."""
    return filings.filter(filing_date(F.col("filing_date")) >= cutoff(as_of, days))


# -- titles and documents ----------------------------------------------------
def filing_title():
    """``10-Q DKNG (2025-08-01)``: form, ticker or else name, date (PJ2)."""
    who = F.coalesce(blank_to_null(F.col("ticker")), blank_to_null(F.col("name")))
    return F.concat_ws(" ", "form", who, F.concat(F.lit("("), F.col("filing_date"), F.lit(")")))


def with_document(filings: DataFrame, captures: DataFrame) -> DataFrame:
    """Filings with the ``url`` of the document to read (JN2, FL8, PJ3).

    The primary document and the filing's index both stand in the folder of the
    filing. Captures outside the wanted folders are left out by their address
    before a body is read; the others are cut down to three small columns and
    collected by folder (a filing's few documents), and each filing then looks
    up its own. Bodies are scanned once and never shuffled, and equal filings
    stay as many as they are.
    """
    cik, accession = F.col("cik10"), F.col("accession")
    inside = "^" + ARCHIVE_ROOT.replace(".", r"\.") + r"(\d+/\d+)/(.+)$"
    wanted = filings.withColumn("_key", archive_key(cik, accession))
    name = F.regexp_extract("url", inside, 2)
    # The exhibit link is asked of index pages only, the item of all others.
    is_index = name.endswith("-index.html")
    seen = captures.filter((F.col("status") < 400) & F.col("url").rlike(inside)).withColumn("_key", F.regexp_extract("url", inside, 1)).join(
        wanted.select("_key").distinct(), "_key", "left_semi").select(
        "_key", F.struct(
            name.alias("name"),
            F.when(~is_index, F.col("body").rlike(ITEM_202)).alias("earnings"),
            F.when(is_index, first_match(F.col("body"), EXHIBIT_LINK, 1)).alias("exhibit"),
        ).alias("_document"))
    folders = seen.groupBy("_key").agg(F.collect_set("_document").alias("_documents"))

    def of(file):
        return F.filter("_documents", lambda d: d["name"] == file)

    none = F.lit(False)
    facts = wanted.join(folders, "_key", "left").select(
        "*", of(F.col("primary_doc")).alias("_primary"), of(F.concat("accession", F.lit("-index.html"))).alias("_index")).select(
        "*",
        F.coalesce(F.size("_primary") > 0, none).alias("_has_primary"),
        F.coalesce(F.exists("_primary", lambda d: F.coalesce(d["earnings"], none)), none).alias("_is_earnings"),
        F.coalesce(F.size("_index") > 0, none).alias("_has_index"),
        F.array_max(F.transform("_index", lambda d: d["exhibit"])).alias("_exhibit"),
    )
    asks_index = (F.col("form") == "8-K") & ~F.col("_is_earnings")
    primary = primary_url(cik, accession, F.col("primary_doc"))
    exhibit = join_url(archive_folder(cik, accession), F.col("_exhibit"))
    url = (
        F.when(F.col("_has_primary") & ~asks_index, primary)
        .when(F.col("_has_primary") & F.col("_has_index"), F.coalesce(exhibit, primary))
        .when(~F.col("_has_primary") & F.col("_has_index"), index_url(cik, accession))
    )
    return facts.withColumn("url", url).filter(F.col("url").isNotNull()).select(*filings.columns, "url")

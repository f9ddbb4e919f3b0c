"""Filing sources: ticker directories, submissions and issuer lists as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.urls import pad_cik

DIRECTORY = "map<string,struct<cik_str:string,ticker:string>>"
SUBMISSIONS = (
    "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,"
    "accessionNumber:array<string>,primaryDocument:array<string>>>>"
)


def ticker_map(directories: DataFrame, body: str = "body", order: str = "directory_id") -> DataFrame:
    """Directory documents to ``ticker_key, cik10``; the last duplicate wins (SC1, JS1, AR2)."""
    entries = directories.select(order, F.posexplode(F.from_json(body, DIRECTORY)).alias("pos", "_", "entry"))
    return (
        entries.select(
            F.lower("entry.ticker").alias("ticker_key"), pad_cik(F.col("entry.cik_str")).alias("cik10"),
            F.struct(order, "pos").alias("_at"),
        )
        .filter(F.col("ticker_key").isNotNull() & F.col("cik10").isNotNull())
        .groupBy("ticker_key").agg(F.max_by("cik10", "_at").alias("cik10"))
    )


def filing_rows(recent: Column) -> Column:
    """The parallel arrays of a submissions document as an array of rows (SC2, AR1, AR3).

    Arrays are cut to the shortest first, since zipping alone pads with nulls;
    a missing array counts as empty.
    """
    names = ("form", "filingDate", "accessionNumber", "primaryDocument")
    columns = [F.coalesce(recent[n], F.array().cast("array<string>")) for n in names]
    shortest = F.array_min(F.array(*[F.size(c) for c in columns]))
    cut = [F.slice(c, F.lit(1), shortest) for c in columns]
    return F.arrays_zip(*[c.alias(n) for c, n in zip(cut, names)])


def filings(submissions: DataFrame, body: str = "body") -> DataFrame:
    """Submissions JSON to one row per filing, position kept in ``pos`` (SC2, JS1)."""
    keep = [c for c in submissions.columns if c != body]
    recent = F.from_json(body, SUBMISSIONS)["filings"]["recent"]
    return (
        submissions.select(*keep, recent.alias("_recent"))
        .select(*keep, F.posexplode(filing_rows(F.col("_recent"))).alias("pos", "_row"))
        .select(
            *keep, "pos", F.col("_row.form").alias("form"), F.col("_row.filingDate").alias("filing_date"),
            F.col("_row.accessionNumber").alias("accession"), F.col("_row.primaryDocument").alias("primary_doc"),
        )
    )


def issuer_list(issuers: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Issuer rows followed by bare tickers, with their input position (SC3, ST2).

    ``issuers`` has ``position, name, ticker, cik``; ``tickers`` has ``position,
    ticker`` and counts as coming after.
    """
    if tickers is None:
        return issuers
    first = issuers.withColumn("position", F.struct(F.lit(0).alias("part"), F.col("position").alias("at")))
    then = tickers.filter(F.trim("ticker") != "").select(
        F.struct(F.lit(1).alias("part"), F.col("position").alias("at")).alias("position"), F.trim("ticker").alias("ticker"))
    return first.unionByName(then, allowMissingColumns=True)


def ir_issuers(issuers: DataFrame) -> DataFrame:
    """Issuer rows with the nested IR settings flattened; absent settings are null (SC4, AR3)."""
    return issuers.select(
        "name", "ticker", "ir.rss", "ir.page", "ir.item_selector", "ir.date_selector")

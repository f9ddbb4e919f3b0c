"""One pass from found items to alerts, as a lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.fixed_values import IR_KEYWORDS, JUNK_SELECTORS, LOOKBACK_DAYS, RNS_KEYWORDS
from tidings.operators.items import first_source_wins, in_window, matches, unseen, valid_items
from tidings.operators.pages import documents, fetched
from tidings.plans.summary import alerts, payloads
from tidings.sources.captures import CAPTURE, at_addresses


def screened(items: DataFrame, as_of, days: int = LOOKBACK_DAYS,
             rns_keywords: str = RNS_KEYWORDS, ir_keywords: str = IR_KEYWORDS) -> DataFrame:
    """Valid items that pass their source's keywords and the lookback (SK3, FL3-FL5, UD2).

    Filings were screened by form and date where they were listed.
    """
    title = F.col("title")
    wanted = (
        F.when(F.col("source") == "lse", matches(title, rns_keywords))
        .when(F.col("source") == "ir", matches(title, ir_keywords))
        .otherwise(True)
    )
    return in_window(valid_items(items).filter(wanted), as_of, days)


def candidates(items: DataFrame, ledger: DataFrame, as_of, days: int = LOOKBACK_DAYS, **keywords: str) -> DataFrame:
    """New items, once each (FL -> WN1 -> JN4); ``keywords`` as in :func:`screened`.

    Both steps work by address: the ledger join reuses the partitioning of the
    first-wins step, and runs before any document is touched.
    """
    return unseen(first_source_wins(screened(items, as_of, days, **keywords)), ledger)


def with_capture(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows with the newest fetched capture of their address (JN5); no body of a landed table is moved."""
    landed = fetched(captures)
    kept = [c for c in ("url", "final_url", "content_type", "status", "body", "captured_at", "digest", CAPTURE) if c in landed.columns]
    return at_addresses(rows, landed.select(*kept))


def alerts_for(candidate_items: DataFrame, captures: DataFrame, junk=JUNK_SELECTORS) -> DataFrame:
    """Alerts of the candidates whose document was fetched (JN5 -> TX1 -> TX10 -> TX13).

    The join comes before cleaning, so only documents that are needed are parsed.
    A PDF has no readable text here: its alert has headline, address and note.
    """
    read = documents(with_capture(candidate_items, captures), junk, pdfs=True).drop("content_type", "status")
    return alerts(payloads(read))


def pending_for(candidate_items: DataFrame, captures: DataFrame) -> DataFrame:
    """Candidates whose document is not there yet; they stay unseen (JN5, IN3)."""
    return candidate_items.join(fetched(captures).select("url"), "url", "left_anti")


def run_once(items: DataFrame, captures: DataFrame, ledger: DataFrame, as_of, days: int = LOOKBACK_DAYS,
             junk=JUNK_SELECTORS, **keywords: str) -> DataFrame:
    """Alerts of one pass. Nothing is written, so this is also the dry run (SK2)."""
    return alerts_for(candidates(items, ledger, as_of, days, **keywords), captures, junk)


#: Order in which alerts are shown: sources by rank, items as they were found.
SHOWN = ("source_rank", "item_idx")


def save_in_order(shown: DataFrame, path: str) -> None:
    """Alerts as files in order of display, each a range of it and sorted inside (LM7). No task holds more than its range."""
    shown.repartitionByRange(*SHOWN).sortWithinPartitions(*SHOWN).write.mode("overwrite").parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`save_in_order` wrote, with its ``place`` in the whole, counted from 1.

    Names of files follow their ranges, so a place is the number of rows in earlier
    files (one number per file) and the row's own in its file.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "_file").withColumn("place", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")

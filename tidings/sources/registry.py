"""Sources as named functions; anything that returns items can take part."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidings.operators.items import counted, valid_items
from tidings.session import stage

LOG = logging.getLogger(__name__)

ITEM_COLUMNS = ("source", "source_rank", "item_idx", "epic", "page_no", "url", "title", "published_at")


@dataclass(frozen=True)
class Source:
    """``read(spark, as_of)`` gives items; ``rank`` decides which source wins a tie (UD1)."""

    name: str
    rank: int
    read: Callable[[SparkSession, object], DataFrame]


def all_items(spark: SparkSession, sources: Iterable[Source], as_of, enabled: Iterable[str] | None = None,
              failed: list[tuple[str, Exception]] | None = None) -> DataFrame:
    """Union of the sources switched on, each with its name and rank (ST1, FL9).

    A source that cannot be planned (its landing folder is missing, say) is
    reported, put on the list ``failed`` and left out; the others go on (IN6).
    """
    wanted = None if enabled is None else set(enabled)
    frames = []
    for s in sources:
        if wanted is not None and s.name not in wanted:
            continue
        try:
            frames.append(s.read(spark, as_of).withColumn("source", F.lit(s.name)).withColumn("source_rank", F.lit(s.rank)))
        except Exception as error:
            LOG.exception("source %s is left out", s.name)
            if failed is not None:
                failed.append((s.name, error))
    if not frames:
        return spark.createDataFrame([], "source string, source_rank int, item_idx bigint, epic string,"
                                         " page_no int, url string, title string, published_at timestamp")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


REPORT = "source string, status string, valid bigint, malformed bigint, error string"


def collected_items(spark: SparkSession, sources: Iterable[Source], as_of, enabled: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid items of the sources switched on, and a report of one row per source (IN6, SK3).

    Each source is run by itself and its items are a table of their own, so a source
    that fails while it runs (a damaged file, say) leaves nothing behind and the
    others whole. Items are counted on their way into the table, malformed ones
    apart; the report has these counts, or the error.
    """
    wanted = None if enabled is None else set(enabled)
    tables, report = [], []
    for s in sources:
        if wanted is not None and s.name not in wanted:
            continue
        seen = Observation(f"items of {s.name}")
        try:
            found = s.read(spark, as_of).withColumn("source", F.lit(s.name)).withColumn("source_rank", F.lit(s.rank))
            # Counted before what is malformed is dropped.
            tables.append(stage(valid_items(counted(found, seen)), f"items-{s.name}"))
        except Exception as error:
            LOG.exception("source %s is left out", s.name)
            report.append((s.name, "failed", None, None, str(error)[:1_000]))
        else:
            counts = seen.get
            report.append((s.name, "ok", counts["valid"], counts["malformed"], None))
    items = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else all_items(spark, [], as_of)
    return items, spark.createDataFrame(report, REPORT)

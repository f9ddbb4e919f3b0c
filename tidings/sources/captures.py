"""Captures as a table in buckets of their address, looked up without moving bodies (JN5, JN7, SC9, SC10).

Landing deals captures into buckets once. A lookup then has two steps: the newest
capture of each address is chosen from narrow columns, bucket by bucket and so
without a shuffle; and the rows that ask for it, narrow as well, are shuffled to the
buckets, where a hash table of them meets the bodies as they are scanned. No
exchange and no sort carries a body, however many there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.joins import first_per_key
from tidings.session import work_folder

#: Name of one capture in a landed table.
CAPTURE = "capture"


def _complete(captures: DataFrame) -> DataFrame:
    """Captures with the columns that decide between several of one address."""
    if "captured_at" not in captures.columns:
        captures = captures.withColumn("captured_at", F.lit(None).cast("timestamp"))
    if "digest" not in captures.columns:
        content = [c for c in ("body", "final_url", "content_type") if c in captures.columns]
        captures = captures.withColumn("digest", F.xxhash64(*content))
    return captures


def land(captures: DataFrame, buckets: int | None = None, table: str | None = None) -> DataFrame:
    """Captures (``url``, ``status``, ``body`` and more) as a table in buckets of ``url``.

    With the name of a ``table`` more captures can be added to one that is there.
    ``buckets`` are as many as shuffle partitions unless given: fewer would make the
    planner shuffle both sides for the sake of more tasks.
    """
    spark = captures.sparkSession
    named = _complete(captures).withColumn(CAPTURE, F.uuid())
    writer = named.write.mode("append").bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "url")
    name = table or f"captures_{uuid.uuid4().hex}"
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", work_folder(spark, "captures"))
    writer.saveAsTable(name)
    return spark.table(name)


def at_addresses(rows: DataFrame, captures: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (``url`` and more) with the newest capture of their address, one for each of its ``parts``.

    Fetched ones come before failed ones, then the newest counts (``captured_at``,
    where captures have it); equal ones are decided by content. Captures that were
    not landed are cut down to the wanted addresses and shuffled, bodies and all.
    """
    given = [c for c in captures.columns if c not in ("captured_at", "digest", CAPTURE)]
    captures, key = _complete(captures), ["url", *parts]
    order = [F.col("status") >= 400, F.desc_nulls_last("captured_at"), "digest"]
    if CAPTURE not in captures.columns:
        wanted = captures.join(rows.select("url").distinct(), "url", "left_semi")
        return rows.join(first_per_key(wanted, key, order).select(*given), "url")
    newest = first_per_key(captures.select(*key, "status", "captured_at", "digest", CAPTURE), key, [*order, CAPTURE])
    asked = rows.join(newest.select("url", F.col(CAPTURE).alias("_newest")), "url").hint("shuffle_hash")
    bodies = captures.select(F.col("url").alias("_at"), F.col(CAPTURE).alias("_capture"), *(F.col(c).alias(c) for c in given if c != "url"))
    # Written as a range, the second condition is checked on rows that meet by address; as an
    # equality it would be a key of the join, which buckets of the address alone do not serve.
    return bodies.join(asked, (F.col("_at") == F.col("url")) & F.col("_capture").between(F.col("_newest"), F.col("_newest"))).drop(
        "_at", "_capture", "_newest")

"""Sharding by a keyed permutation of global row numbers.

Rows are numbered in order of id. A Feistel network permutes the numbers of the
next power of four, and cycle walking (values beyond the last row go through
again) makes that a permutation of the rows themselves. Place ``p`` of the
permutation is slot ``p // shards`` of shard ``p % shards``: shards differ by
one row at most, slots have no gaps, and both directions are computed from the
number alone, without a table.

Defined results: a null text has no bytes and checksum 0; rows without an id
come first in the order; rows that are equal in id, checksum and size are
interchangeable. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.store import written

ROUNDS = 6


def _mixed(values: np.ndarray, round_key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser over values and key; wraps around by design."""
    z = values + round_key
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Shuffle:
    """A reproducible permutation of ``range(rows)``."""

    def __init__(self, rows: int, key: int):
        self.rows = rows
        self.half = np.uint64(max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64((key + (i + 1) * 0x9E3779B97F4A7C15) % 2**64) for i in range(ROUNDS)]

    def _network(self, values: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = values >> self.half, values & self.mask
        for key in keys:
            left, right = right, (left ^ _mixed(right, key)) & self.mask
        return left << self.half | right

    def _swapped(self, values: np.ndarray) -> np.ndarray:
        return (values & self.mask) << self.half | values >> self.half

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = step(values.astype(np.uint64))
        while len(beyond := np.flatnonzero(out >= np.uint64(self.rows))):
            out[beyond] = step(out[beyond])
        return out.astype(np.int64)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Where the rows of these numbers go."""
        return self._walk(numbers, lambda v: self._network(v, self.keys))

    def number(self, places: np.ndarray) -> np.ndarray:
        """Which rows are at these places: the network backwards."""
        return self._walk(places, lambda v: self._swapped(self._network(self._swapped(v), self.keys[::-1])))


def numbered(frame: DataFrame, order: list[str], number: str = "row_number") -> DataFrame:
    """The rows with their global number from 0 in the given order.

    A range sort and a count per range; the counts, one row for each partition,
    are all that is broadcast.
    """
    at = F.monotonically_increasing_id()
    ranges = written(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "ranges")
    # The id holds the partition above bit 33 and the row in it below.
    ranges = ranges.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return ranges.join(F.broadcast(starts), "range").withColumn(number, F.col("start") + F.col("at")).drop("range", "start", "at")


def shard(documents: DataFrame, shards: int = 8, key: int = 20240229) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``documents``."""
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    total = documents.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(Shuffle(total, key).place(numbers.to_numpy()))

    return rows.withColumn("place", place("row_number")).select(
        "doc_id", "size", "text_crc32", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot"))

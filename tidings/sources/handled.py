"""The ledger as a table of addresses in buckets (IN2, AG7, ST5).

Addresses lie in *runs*, each a folder partitioned by a hash of the address:

    <base>/<stream>.<level>.<from>-<to>/bucket=<b>/...

A micro-batch adds a run of its own (level 0, from = to = its number). When
``fan`` runs of one level follow one another they are merged into one of the next
level, so an address is rewritten a few times however long the ledger gets, and
a lookup meets at most ``fan`` runs per level. A run counts once it is committed
and as long as no committed run covers its batches; that follows from names alone,
so no file has to be replaced in place, and a step that broke off is done again
without harm.

A lookup reads only the buckets that its rows fall into: these are found while the
query runs and prune the scan (dynamic partition pruning). They are at most
``buckets`` numbers, which bounds what is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, bucket int"
_RUN = re.compile(r"(.+)\.(\d+)\.(\d+)-(\d+)")


@dataclass(frozen=True, order=True)
class Run:
    """The addresses of some batches of a stream."""

    stream: str
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.stream}.{self.level}.{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return (self.stream, self.level) > (other.stream, other.level) and self.stream == other.stream and (
            self.first <= other.first and other.last <= self.last)


@dataclass(frozen=True)
class Handled:
    """Addresses already handled, below a base folder. ``buckets`` stays the same for good."""

    spark: SparkSession
    base: str
    buckets: int = 64
    fan: int = 8

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    # -- runs ----------------------------------------------------------------
    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[Run]:
        """All runs that were written to the end. Names of folders only; there are some ``fan`` of them per level."""
        files, base = self._files()
        if not files.exists(base):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [(_RUN.fullmatch(status.getPath().getName()), status.getPath()) for status in files.listStatus(base)]
        return sorted(
            Run(match[1], int(match[2]), int(match[3]), int(match[4])) for match, at in found if match and files.exists(path(at, "_SUCCESS")))

    def live(self) -> list[Run]:
        """Runs that no other run covers."""
        runs = self.committed()
        return [run for run in runs if not any(other.covers(run) for other in runs)]

    def done(self, stream: str, batch_id: int) -> bool:
        """Whether a batch's addresses are committed; they are the last thing that it writes."""
        return any(run.stream == stream and run.first <= batch_id <= run.last for run in self.committed())

    def last(self, stream: str) -> int:
        """Number of the last batch of a stream, -1 if there is none."""
        return max((run.last for run in self.committed() if run.stream == stream), default=-1)

    # -- writing -------------------------------------------------------------
    def _write(self, addresses: DataFrame, run: Run) -> None:
        rows = addresses.select("url").where("url IS NOT NULL").distinct().withColumn("bucket", self.bucket(F.col("url")))
        # One file for each bucket.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{run.name}")

    def add(self, addresses: DataFrame, stream: str, batch_id: int) -> None:
        """Addresses of one batch; a replayed batch replaces its own."""
        self._write(addresses, Run(stream, 0, batch_id, batch_id))

    def merge(self, stream: str, before: int) -> None:
        """Merge runs of one level, lowest level first, where ``fan`` of them have come together.

        Only batches before ``before`` take part: they are not replayed any more.
        What was covered already when this began is removed.
        """
        runs = self.committed()
        files, base = self._files()
        for run in runs:
            if any(other.covers(run) for other in runs):
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(base, run.name), True)
        live, level = [run for run in self.live() if run.stream == stream and run.last < before], 0
        while level <= max((run.level for run in live), default=-1):
            group = sorted((run for run in live if run.level == level), key=lambda run: run.first)
            if len(group) >= self.fan:
                merged = Run(stream, level + 1, group[0].first, group[-1].last)
                self._write(self._read(group), merged)
                live = [run for run in live if run.level != level] + [merged]
            level += 1

    # -- reading -------------------------------------------------------------
    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], SCHEMA)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(SCHEMA).parquet(f"{self.base}/{run.name}") for run in runs])

    def addresses(self, stream: str | None = None, before: int | None = None) -> DataFrame:
        """``url, bucket`` of everything handled; of ``stream`` only batches before ``before``."""
        return self._read([run for run in self.live() if run.stream != stream or before is None or run.last < before])

    def among(self, rows: DataFrame, stream: str | None = None, before: int | None = None) -> DataFrame:
        """Handled addresses in the buckets that ``rows`` (``url``) fall into."""
        # The condition holds for all; a side with one may prune the other.
        wanted = rows.select(self.bucket(F.col("url")).alias("bucket")).where("bucket >= 0").distinct()
        return self.addresses(stream, before).join(F.broadcast(wanted), "bucket", "left_semi")

    def unseen(self, rows: DataFrame, stream: str | None = None, before: int | None = None) -> DataFrame:
        """Rows whose address is not handled (JN4). ``rows`` should be a table: they are read twice."""
        return rows.join(self.among(rows, stream, before).select("url"), "url", "left_anti")

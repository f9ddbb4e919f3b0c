"""Repeated passes over landing folders with Structured Streaming.

Tables below one base folder, all partitioned by stream and micro-batch:

* ``candidates``: items a batch took up;
* ``outbox``: alerts;
* ``waiting``: events of items without a document yet (:mod:`tidings.streaming.pending`);
* ``handled``: the addresses of the outbox, in buckets (:mod:`tidings.sources.handled`),
  so a batch looks its items up without reading the outbox.

Every partition is written in overwrite mode under its batch number, addresses
last: they are the batch's commit. Until then nobody is shown its alerts
(:meth:`Store.alerts`), and a replay replaces what it wrote; from then on a replay
does nothing, so alerts that can be seen are never half overwritten.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidings.fixed_values import JUNK_SELECTORS, LOOKBACK_DAYS
from tidings.operators.items import first_source_wins
from tidings.plans.cycle import alerts_for, screened
from tidings.sources.handled import Handled
from tidings.streaming.pending import DONE, STATE_STORE, TICK, WAIT, tick, tries

ITEMS = ("source string, source_rank int, item_idx bigint, epic string, page_no int,"
         " url string, title string, published_at timestamp")
_KEYS = ", stream string, batch_id bigint"
_FIGURES = ", ".join(f"{m} struct<current:string,yoy:string>" for m in ("revenue", "ebitda", "net_income", "eps"))
OUTBOX = ("url string, source string, source_rank int, item_idx bigint, epic string, page_no int,"
          " published_at timestamp, headline string, final_url string, short_summary string,"
          f" key_highlights array<string>, {_FIGURES}, final_thoughts string, subject string, body string")

COLUMNS = {"candidates": ITEMS, "outbox": OUTBOX}


@dataclass(frozen=True)
class Store:
    """The tables of one stream below a base folder."""

    spark: SparkSession
    base: str
    stream: str = "items"

    def _at(self, path: str, schema: str) -> DataFrame | None:
        """A table that may not be there yet."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, name: str) -> DataFrame:
        schema = COLUMNS[name] + _KEYS
        rows = self._at(f"{self.base}/{name}", schema)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.base}/{name}/stream={self.stream}/batch_id={batch_id}"

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(name, batch_id))

    def of_batch(self, name: str, batch_id: int) -> DataFrame:
        """One batch, read by its own folder; the others are not listed."""
        rows = self._at(self._path(name, batch_id), COLUMNS[name])
        return self.spark.createDataFrame([], COLUMNS[name]) if rows is None else rows

    @property
    def handled(self) -> Handled:
        return Handled(self.spark, f"{self.base}/handled")

    def alerts(self) -> DataFrame:
        """Alerts of committed batches, of all streams (SK2, IN5)."""
        runs = self.handled.live()
        shown = [(F.col("stream") == run.stream) & F.col("batch_id").between(run.first, run.last) for run in runs]
        return self.read("outbox").where(reduce(Column.__or__, shown, F.lit(False)))

    @property
    def events(self) -> str:
        """Folder of events of items that wait."""
        return f"{self.base}/waiting/{self.stream}"

    def tell(self, event: str, rows: DataFrame, name: str) -> None:
        """Events for items or addresses, in a folder of their own; a replayed batch replaces its own."""
        rows = rows.withColumn("event", F.lit(event))
        rows.write.mode("overwrite").parquet(f"{self.events}/{name}")

    def pending(self, batch_id: int) -> DataFrame:
        """What a batch took up and did not handle (IN3)."""
        done = self.of_batch("outbox", batch_id).select("url")
        return self.of_batch("candidates", batch_id).join(done, "url", "left_anti")

    def intake(self, rows: DataFrame) -> DataFrame:
        """Rows written once and read back; one folder, replaced by every batch."""
        path = f"{self.base}/intake/{self.stream}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def taken_columns() -> list[str]:
    """Columns of the outbox, in order."""
    return [field.name for field in StructType.fromDDL(OUTBOX)]


def _columns() -> list[str]:
    return [c.strip().split(" ")[0] for c in ITEMS.split(",")]


def process_batch(store: Store, items: DataFrame, batch_id: int, captures: DataFrame, as_of,
                  days: int = LOOKBACK_DAYS, imported: DataFrame | None = None, junk=JUNK_SELECTORS, **keywords: str) -> None:
    """One micro-batch: items to alerts (IN2, IN4-IN6); what has no document is told to wait (IN3).

    What a batch takes up is written and read back, so its true size decides
    whether it is sent past the ledger and the captures or joined by address.
    ``junk`` and ``keywords`` are those of a single pass.
    """
    if store.handled.done(store.stream, batch_id):
        return
    fresh = store.intake(first_source_wins(screened(items.select(*_columns()), as_of, days, **keywords)))
    fresh = store.handled.unseen(fresh, store.stream, batch_id)
    if imported is not None:
        known = imported.select("url").join(fresh.select("url"), "url", "left_semi")
        fresh = fresh.join(known, "url", "left_anti")
    store.write("candidates", fresh.select(*_columns()), batch_id)

    taken = store.of_batch("candidates", batch_id)
    store.write("outbox", alerts_for(taken, captures, junk).select(*taken_columns()), batch_id)
    store.tell(WAIT, store.pending(batch_id), f"wait-{batch_id}")
    store.handled.add(store.of_batch("outbox", batch_id), store.stream, batch_id)
    store.handled.merge(store.stream, batch_id)


def retry_batch(store: Store, due: DataFrame, batch_id: int, captures: DataFrame, as_of, days: int = LOOKBACK_DAYS,
                junk=JUNK_SELECTORS, **keywords: str) -> None:
    """Items that are due for another try, under a stream of their own.

    They are screened again, so what left the lookback is given up, and looked up
    again, as another batch may have handled their address. Either way, and if there
    is an alert, the address is told to be done.
    """
    again = replace(store, stream=f"{store.stream}-retry")
    if again.handled.done(again.stream, batch_id):
        return
    due = again.intake(due.select(*_columns()))
    open_ = again.handled.unseen(first_source_wins(screened(due, as_of, days, **keywords)), again.stream, batch_id)
    again.write("candidates", open_.select(*_columns()), batch_id)
    again.write("outbox", alerts_for(again.of_batch("candidates", batch_id), captures, junk).select(*taken_columns()), batch_id)
    store.tell(DONE, due.join(again.pending(batch_id).select("url"), "url", "left_anti"), f"done-{batch_id}")
    again.handled.add(again.of_batch("outbox", batch_id), again.stream, batch_id)
    again.handled.merge(again.stream, batch_id)


def run_retries(store: Store, captures: Callable[[], DataFrame], as_of, days: int = LOOKBACK_DAYS, retry: datetime.timedelta = datetime.timedelta(0),
                every: str | None = None, junk=JUNK_SELECTORS, **keywords: str) -> StreamingQuery:
    """Follow the items that wait (IN3): each is tried again after ``retry``, until ``days`` have passed.

    By default what is due now is tried and the query ends; with ``every`` it keeps running.
    """
    conf = store.spark.conf
    conf.set(*STATE_STORE)
    store.tell(TICK, tick(store.spark), f"tick-{uuid.uuid4().hex}")
    # A batch that is replayed writes its events anew; what it wrote before is gone.
    events = store.spark.readStream.schema(f"{ITEMS}, event string").option("ignoreMissingFiles", "true").option("cleanSource", "delete").parquet(
        f"{store.events}/*")

    def handle(due: DataFrame, batch_id: int) -> None:
        retry_batch(store, due, batch_id, captures(), as_of, days, junk, **keywords)

    writer = tries(events, retry, datetime.timedelta(days=days)).writeStream.foreachBatch(handle).outputMode("update").option(
        "checkpointLocation", f"{store.base}/progress/{store.stream}-retry")
    if every:
        return writer.trigger(processingTime=every).start()
    # One batch: it looks at all timers, and without this the next would follow at once.
    before = conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)


def run_incremental(store: Store, landing: str, captures: Callable[[], DataFrame], as_of, days: int = LOOKBACK_DAYS,
                    imported: DataFrame | None = None, files_per_batch: int | None = None,
                    every: str | None = None, junk=JUNK_SELECTORS, **keywords: str) -> StreamingQuery:
    """Follow a landing folder of item files (IN1).

    By default all files landed so far are taken up and the query ends; with
    ``every`` (such as ``"60 seconds"``) it keeps polling. ``captures`` is
    called in each batch, so documents that arrived since are found. Items without
    a document are tried again by :func:`run_retries`, which runs beside this.
    """
    reader = store.spark.readStream.schema(ITEMS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        process_batch(store, batch, batch_id, captures(), as_of, days, imported, junk, **keywords)

    writer = (
        reader.parquet(landing).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{store.base}/progress/{store.stream}")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_pass(store: Store, landing: str, captures: Callable[[], DataFrame], as_of, days: int = LOOKBACK_DAYS,
             imported: DataFrame | None = None, files_per_batch: int | None = None, **how) -> None:
    """One run as a scheduled job has it: what waits is tried again, then all new files are taken up (IN1, IN3)."""
    run_retries(store, captures, as_of, days, **how).awaitTermination()
    run_incremental(store, landing, captures, as_of, days, imported, files_per_batch, **how).awaitTermination()

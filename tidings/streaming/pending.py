"""Items whose document has not landed, as state with timers (IN3).

Micro-batches of new items put what they could not handle into a folder of events,
and a stateful query follows that folder. It keeps for each address the item
that came first, with a time for the next try, and gives it up at the end of the lookback. A try
sends the item out again; its batch looks for documents and writes alerts as any
other, and tells the folder which addresses are done, so their state goes with the
next events. Between tries no batch carries an item over.

Addresses lie in buckets, and a bucket is one state value with one timer, its earliest
try. Spark calls Python once per value, which costs milliseconds, so a value per
address would cost that for every one of them in every pass.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State on disk, so that memory does not bound it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: ``wait``: an item to keep; ``done``: nothing more to do for the address; ``tick``: a pass has begun.
WAIT, DONE, TICK = "wait", "done", "tick"
#: Address of ticks.
NO_ADDRESS = ""

ITEM = "source string, source_rank int, item_idx bigint, epic string, page_no int, title string, published_at timestamp"
_FIELDS = [f.split()[0] for f in ITEM.split(", ")]
#: An item inside its text: the time in microseconds, which a text of a time would cut.
_PACKED = ITEM.replace("published_at timestamp", "published_at bigint")
#: One bucket: address by address the item that waits, when it is given up, and its next try.
STATE = "urls array<string>, items array<string>, until array<bigint>, due array<bigint>"
#: Number of buckets; it stays the same for good.
BUCKETS = 1_024


def _place(item: str) -> tuple:
    """Where an item stands among those of one address; missing numbers come last."""
    held = json.loads(item)
    return tuple((held.get(name) is None, held.get(name) or 0) for name in ("source_rank", "item_idx"))


class Waiting:
    """What happens to one bucket of addresses: their events, or their timer."""

    def __init__(self, retry_ms: int, hold_ms: int):
        self.retry_ms, self.hold_ms = retry_ms, hold_ms

    def __call__(self, key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {url: of for url, *of in zip(*state.get)} if state.exists else {}
        # Never the moment that has just come, so a batch tries an item once.
        again = now + max(1, self.retry_ms)
        done, waiting = set(), {}
        for events in () if state.hasTimedOut else batches:
            for url, event, item in zip(events["url"], events["event"], events["item"]):
                if event == DONE:
                    done.add(url)
                elif event == WAIT:
                    waiting.setdefault(url, []).append(item)
        for url in done:
            held.pop(url, None)
        tried = {}
        for url in [url for url, (_, _, due) in held.items() if due <= now]:
            item, until, _ = held[url]
            if now >= until:
                del held[url]
            else:
                tried[url], held[url] = item, (item, until, again)
            waiting.pop(url, None)
        for url, items in waiting.items():
            if url not in done and url not in held:
                first = items[0] if len(items) == 1 else min(items, key=_place)
                # Its document may have landed since the batch that looked for it.
                tried[url], held[url] = first, (first, now + self.hold_ms, again)
        if held:
            state.update((list(held), *(list(column) for column in zip(*held.values()))))
            state.setTimeoutDuration(max(1, min(due for _, _, due in held.values()) - now))
        elif state.exists:
            state.remove()
        if tried:
            yield pd.DataFrame({"url": list(tried), "item": list(tried.values())})


def tries(events: DataFrame, retry: datetime.timedelta, hold: datetime.timedelta, buckets: int = BUCKETS) -> DataFrame:
    """Items that are due for another try, from a stream of events (``event``, ``url`` and the item)."""
    handler = Waiting(int(retry.total_seconds() * 1000), int(hold.total_seconds() * 1000))

    def handle(key, batches, state):
        yield from handler(key, batches, state)

    packed = events.withColumn("published_at", F.unix_micros("published_at")).select(
        F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket"), "url", "event", F.to_json(F.struct(*_FIELDS)).alias("item"))
    due = packed.groupBy("bucket").applyInPandasWithState(
        handle, "url string, item string", STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    item = due.select("url", F.from_json("item", _PACKED).alias("item")).select("url", "item.*")
    return item.withColumn("published_at", F.timestamp_micros("published_at"))


def tick(spark: SparkSession) -> DataFrame:
    """An event that makes a pass run although nothing new came, so that timers are looked at."""
    return spark.range(1).select(F.lit(TICK).alias("event"), F.lit(NO_ADDRESS).alias("url"))

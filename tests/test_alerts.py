"""Documents to payloads to alerts, in one pass and incrementally."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidings.operators.pages import documents, pdf_captures
from tidings.plans import cycle
from tidings.plans.summary import alerts, payloads
from tidings.streaming import pending
from tidings.streaming.incremental import ITEMS, OUTBOX, Store, process_batch, run_incremental, run_pass, run_retries

AS_OF = "2024-01-31"
CAPTURE = "url string, final_url string, content_type string, status int, body string"


def capture(url, body="<title>T</title><p>Revenue of $5 m. The outlook is stable.</p>", status=200, kind="text/html"):
    return (url, url, kind, status, body)


def item(idx, url, title="Results", source="ir", at=None):
    return (source, {"edgar": 0, "lse": 1, "ir": 2}[source], idx, "A", 1, url, title, at)


def payload(spark, title, text, title_html=None):
    rows = spark.createDataFrame([("u", "f", title, title_html, text)], "url string, final_url string, title string, title_html string, text string")
    return payloads(rows)


def test_payload_without_figures(spark):
    row = payload(spark, None, "nothing here").first()
    assert (row.headline, row.short_summary, row.key_highlights, row.revenue) == ("u", "u", [], None)
    assert row.final_thoughts.startswith("Could not confidently")
    assert payload(spark, "", "x", "Page").first().headline == "Page"


def test_alert_text(spark):
    text = "In Q3 2024 revenue was $5 m, up 3%. EPS 0.45 then. Guidance is raised."
    row = alerts(payload(spark, " Title ", text)).first()
    assert row.subject == "[Earnings Watch] Title"
    assert row.body == (
        "Headline: Title\nURL: f\n\nSummary: Q3 2024 results: Revenue $5 m (up 3%) EPS 0.45 (up 3%)\n\n"
        "Key Highlights:\n - Revenue: $5 m (up 3%)\n - EPS: 0.45 (up 3%)\n - Guidance is raised.\n\n"
        "Metrics:\n - Revenue: $5 m (up 3%)\n - EPS: 0.45 (up 3%)\n")


def test_alert_leaves_empty_sections_out(spark):
    row = alerts(payload(spark, "T", "nothing")).first()
    assert row.body == ("Headline: T\nURL: f\n\nSummary: T\n\n"
                        "Notes: Could not confidently extract KPIs; included link and summary context.\n")


def test_highlights_are_distinct_and_limited(spark):
    text = ("Revenue of $1 m. EBITDA of $2 m. Net income of $3 m. EPS of $4. " + "pad " * 60
            + ". The outlook is good. " + "pad " * 60 + ". Guidance is up. ")
    assert len(payload(spark, "T", text).first().key_highlights) == 6
    assert len(payloads(payload_rows(spark, text), max_highlights=3).first().key_highlights) == 3


def payload_rows(spark, text):
    return spark.createDataFrame([("u", "f", "T", None, text)], "url string, final_url string, title string, title_html string, text string")


def test_documents_route_pdfs_and_failures_out(spark):
    rows = spark.createDataFrame([
        capture("a"), capture("b.PDF"), capture("c", kind="Application/PDF; x"), capture("d", status=404), capture("e", kind=None)], CAPTURE)
    assert sorted(r.url for r in documents(rows).collect()) == ["a", "e"]
    assert sorted(r.url for r in pdf_captures(rows).collect()) == ["b.PDF", "c"]
    assert documents(rows.filter("url = 'a'")).first().text == "T Revenue of $5 m. The outlook is stable."


def test_one_pass(spark):
    items = spark.createDataFrame([
        item(1, "a"), item(2, "a", "Q1 title", "edgar"), item(3, "b"), item(4, "c"), item(5, "d", "Board"),
        item(6, "e", at=datetime(2020, 1, 1)), item(7, "")], ITEMS)
    captures = spark.createDataFrame([capture(u) for u in "abde"], CAPTURE)
    seen = spark.createDataFrame([("b",)], "url string")
    found = cycle.candidates(items, seen, AS_OF)
    assert sorted((r.url, r.source) for r in found.collect()) == [("a", "edgar"), ("c", "ir")]
    assert [(r.url, r.subject) for r in cycle.alerts_for(found, captures).collect()] == [("a", "[Earnings Watch] Q1 title")]
    assert [r.url for r in cycle.pending_for(found, captures).collect()] == ["c"]


def outbox(store):
    return sorted((r.url, r.item_idx, r.batch_id) for r in store.read("outbox").collect())


def test_outbox_schema_matches_alerts(spark):
    empty = cycle.run_once(spark.createDataFrame([], ITEMS), spark.createDataFrame([], CAPTURE), spark.createDataFrame([], "url string"), AS_OF)
    declared = spark.createDataFrame([], OUTBOX).schema
    assert {f.name: f.dataType.simpleString() for f in empty.schema} == {f.name: f.dataType.simpleString() for f in declared}


def test_items_without_a_document_wait_and_handled_ones_never_come_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    have = spark.createDataFrame([capture("a")], CAPTURE)
    process_batch(store, spark.createDataFrame([item(1, "a"), item(2, "b")], ITEMS), 0, have, AS_OF)
    assert outbox(store) == [("a", 1, 0)]
    assert [r.url for r in store.pending(0).collect()] == ["b"]
    process_batch(store, spark.createDataFrame([item(3, "a")], ITEMS), 1, have, AS_OF)
    assert outbox(store) == [("a", 1, 0)] and store.pending(1).count() == 0


def events(spark, store, kind):
    rows = spark.read.schema(f"{ITEMS}, event string").parquet(f"{store.events}/*").where(F.col("event") == kind)
    return sorted({r.url for r in rows.collect()})


def test_waiting_items_are_given_up_outside_the_lookback(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    none = spark.createDataFrame([], CAPTURE)
    process_batch(store, spark.createDataFrame([item(1, "a", at=datetime(2024, 1, 20)), item(2, "b")], ITEMS), 0, none, AS_OF, 14)
    run_retries(store, lambda: none, AS_OF, 14).awaitTermination()
    # The next pass tries both; one has left the lookback by then.
    run_retries(store, lambda: none, "2024-03-01", 14).awaitTermination()
    assert events(spark, store, "done") == ["a"]
    have = spark.createDataFrame([capture("a"), capture("b")], CAPTURE)
    run_retries(store, lambda: have, AS_OF, 14).awaitTermination()
    assert [u for u, _, _ in outbox(store)] == ["b"]


def test_state_ends_with_the_hold(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    none = spark.createDataFrame([], CAPTURE)
    process_batch(store, spark.createDataFrame([item(1, "a")], ITEMS), 0, none, AS_OF)
    run_retries(store, lambda: none, AS_OF, days=0).awaitTermination()
    run_retries(store, lambda: none, AS_OF, days=0).awaitTermination()
    have = spark.createDataFrame([capture("a")], CAPTURE)
    run_retries(store, lambda: have, AS_OF).awaitTermination()
    assert outbox(store) == []


class HeldState:
    """State of one bucket, as Spark hands it to the handler."""

    def __init__(self, now):
        self.now, self.get, self.timeout, self.hasTimedOut = now, None, None, False

    exists = property(lambda self: self.get is not None)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def told(*events):
    return iter([pd.DataFrame(events, columns=["url", "event", "item"])])


def test_one_call_serves_all_addresses_of_a_bucket():
    handler, state = pending.Waiting(retry_ms=100, hold_ms=250), HeldState(1_000)
    call = lambda *events: sorted(row for out in handler((0,), told(*events), state) for row in out.itertuples(index=False, name=None))
    first, later = '{"source_rank":0,"item_idx":9007199254740993}', '{"source_rank":0,"item_idx":9007199254740994}'
    many = [(f"u{i}", "wait", first) for i in range(5_000)]
    assert call(*many, ("u0", "wait", later), ("", "tick", "{}")) == sorted((u, first) for u, _, _ in many)
    assert state.timeout == 100
    # Told again before the next try, one is done, one is new: only the new one is tried.
    state.now = 1_050
    assert call(("u1", "wait", later), ("u2", "done", "{}"), ("new", "wait", '{"epic":"E"}'), ("gone", "wait", first), ("gone", "done", "{}")) == [("new", '{"epic":"E"}')]
    assert state.timeout == 50
    # The timer: all but the new one are due.
    state.now, state.hasTimedOut = 1_101, True
    assert [u for u, _ in call()] == sorted(u for u, _, _ in many if u != "u2")
    # Beyond the hold they are given up, the new one a little later.
    state.now = 1_260
    assert call() == [("new", '{"epic":"E"}')]
    state.now = 2_000
    assert call() == [] and not state.exists


def test_waiting_items_come_back_exactly(spark, tmp_path):
    rows = [(f"u{i}", "ir", None if i == 2 else 1, None if i == 1 else 2**53 + 1, 'E"\n', None, None if i == 3 else "Results", datetime(2024, 1, 20, 1, 2, 3, 456789), "wait")
            for i in range(5)]
    schema = f"url string, {pending.ITEM}, event string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events")
    spark.conf.set(*pending.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = []
    stream = pending.tries(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), timedelta(days=1), timedelta(days=2), buckets=2)
    writer = stream.writeStream.foreachBatch(lambda due, _: out.extend(due.collect())).outputMode("update")
    writer.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    assert sorted((tuple(r) for r in out), key=str) == [r[:-1] for r in rows]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_replay_of_a_batch_replaces_its_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    have = spark.createDataFrame([capture("a"), capture("b")], CAPTURE)
    rows = spark.createDataFrame([item(1, "a"), item(2, "b")], ITEMS)
    process_batch(store, rows, 0, have, AS_OF)
    process_batch(store, rows, 0, have, AS_OF)
    assert outbox(store) == [("a", 1, 0), ("b", 2, 0)]


def test_alerts_are_shown_once_their_batch_is_committed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    have = spark.createDataFrame([capture("a"), capture("b")], CAPTURE)
    rows = spark.createDataFrame([item(1, "a")], ITEMS)
    assert store.alerts().count() == 0
    # A batch that broke off behind its outbox: seen by none, and done again.
    process_batch(store, spark.createDataFrame([item(7, "b")], ITEMS), 0, have, AS_OF)
    (tmp_path / "handled" / "items.0.0-0" / "_SUCCESS").unlink()
    assert outbox(store) == [("b", 7, 0)] and store.alerts().count() == 0
    process_batch(store, rows, 0, have, AS_OF)
    assert [(r.url, r.item_idx) for r in store.alerts().collect()] == [("a", 1)]
    # Committed: a replay changes nothing, not even with other rows.
    process_batch(store, spark.createDataFrame([item(7, "b")], ITEMS), 0, have, AS_OF)
    assert [(r.url, r.item_idx) for r in store.alerts().collect()] == [("a", 1)]


def test_imported_ledger_and_other_streams_count_as_seen(spark, tmp_path):
    have = spark.createDataFrame([capture(u) for u in "abc"], CAPTURE)
    one, two = (Store(spark, str(tmp_path), name) for name in ("one", "two"))
    process_batch(one, spark.createDataFrame([item(1, "a")], ITEMS), 0, have, AS_OF)
    process_batch(two, spark.createDataFrame([item(1, "a"), item(2, "b"), item(3, "c")], ITEMS), 0, have, AS_OF,
                  imported=spark.createDataFrame([("b",)], "url string"))
    assert outbox(two) == [("a", 1, 0), ("c", 3, 0)]


def test_a_capture_that_comes_late_needs_no_new_item(spark, tmp_path):
    landing, store = f"{tmp_path}/landing", Store(spark, f"{tmp_path}/tables")
    have = [capture("a")]
    captures = lambda: spark.createDataFrame(have, CAPTURE)
    spark.createDataFrame([item(1, "a"), item(2, "b"), item(3, "c")], ITEMS).write.parquet(landing)
    run_pass(store, landing, captures, AS_OF)
    assert [u for u, _, _ in outbox(store)] == ["a"]
    have.append(capture("b"))
    run_pass(store, landing, captures, AS_OF)
    assert [u for u, _, _ in outbox(store)] == ["a", "b"]
    have.append(capture("c"))
    run_pass(store, landing, captures, AS_OF)
    run_pass(store, landing, captures, AS_OF)
    assert [u for u, _, _ in outbox(store)] == ["a", "b", "c"]


def test_repeated_captures_and_pdfs_give_one_alert_each(spark):
    items = spark.createDataFrame([item(1, "a"), item(2, "b.pdf", "\tResults\u00a0")], ITEMS)
    captures = spark.createDataFrame([capture("a"), capture("a"), capture("b.pdf"), capture("b.pdf", kind="application/pdf")], CAPTURE)
    times = captures.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    newer = spark.createDataFrame([capture("a")], CAPTURE).withColumn("body", F.lit("<p>Revenue of $9 m.")).withColumn("captured_at", F.lit("2024-01-02").cast("timestamp"))
    seen = spark.createDataFrame([], "url string")
    rows = {r.url: r for r in cycle.run_once(items, times.unionByName(newer), seen, AS_OF).collect()}
    assert len(rows) == 2 == cycle.run_once(items, captures, seen, AS_OF).count()
    assert "9" in rows["a"].revenue.current
    assert rows["b.pdf"].subject == "[Earnings Watch] Results" and rows["b.pdf"].final_thoughts and not rows["b.pdf"].key_highlights


def test_stream_follows_a_folder(spark, tmp_path):
    landing, store = f"{tmp_path}/landing", Store(spark, f"{tmp_path}/tables")
    have = spark.createDataFrame([capture(u) for u in "abc"], CAPTURE)
    for rows in ([item(1, "a"), item(2, "b")], [item(3, "b"), item(4, "c")], []):
        if rows:
            spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(landing)
        run_incremental(store, landing, lambda: have, AS_OF, files_per_batch=1).awaitTermination()
    assert outbox(store) == [("a", 1, 0), ("b", 2, 0), ("c", 4, 1)]


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 2)), min_size=1, max_size=12))
def test_any_split_alerts_the_same_addresses_as_one_batch(spark, tmp_path_factory, rows):
    have = spark.createDataFrame([capture(u) for u in "abde"], CAPTURE)
    items = [item(i, u) for i, (u, _) in enumerate(rows)]
    store = Store(spark, str(tmp_path_factory.mktemp("split")))
    for batch in range(3):
        part = [it for it, (_, k) in zip(items, rows) if k == batch]
        process_batch(store, spark.createDataFrame(part, ITEMS), batch, have, AS_OF)
    once = cycle.run_once(spark.createDataFrame(items, ITEMS), have, spark.createDataFrame([], "url string"), AS_OF)
    assert sorted(u for u, _, _ in outbox(store)) == sorted(r.url for r in once.collect())

"""Captures in buckets: the newest counts, and no body is moved for a lookup."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.test_plans import no_broadcast, plan  # noqa: F401
from tidings.plans import cycle
from tidings.sources import watchers
from tidings.sources.captures import at_addresses, land

SF = "/root/testdata/sf0.01"
SCHEMA = "url string, final_url string, content_type string, status int, body string, captured_at timestamp"


def captures(spark):
    at = lambda day: __import__("datetime").datetime(2024, 1, day)
    return spark.createDataFrame([
        ("a", "a", "text/html", 200, "old", at(1)), ("a", "a", "text/html", 200, "new", at(3)), ("a", "a", "text/html", 404, "gone", at(5)),
        ("b", "b", "text/html", 500, "down", at(1)), ("c", "c", "text/html", 200, "same", None), ("c", "c", "text/html", 200, "same", None),
        ("c", "c", "text/html", 200, None, None), ("d", None, None, None, "no status", at(1)), (None, "x", "text/html", 200, "no address", at(1)),
        ("e", "e", "text/html", 200, "alone", None)], SCHEMA)


@pytest.mark.parametrize("landed", [False, True])
def test_newest_fetched_capture_for_every_row(spark, landed):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "zzz"), (6, None), (7, "e")], "n int, url string")
    pages = land(captures(spark)) if landed else captures(spark)
    found = {(r["n"], r["body"]) for r in at_addresses(rows, pages).collect()}
    assert {f for f in found if f[0] != 4} == {(1, "new"), (2, "new"), (3, "down"), (7, "alone")}
    assert len([f for f in found if f[0] == 4]) == 1
    assert {r["n"] for r in cycle.with_capture(rows, pages).collect()} == {1, 2, 4, 7}


def test_both_ways_agree_and_more_can_be_landed(spark):
    rows = spark.range(300).selectExpr("id % 90 AS n", "concat('u', id % 90) AS url").distinct()
    pages = spark.range(2_000).selectExpr(
        "concat('u', id % 120) AS url", "CASE WHEN id % 7 = 0 THEN 404 ELSE 200 END AS status", "concat('body ', id) AS body",
        "timestamp_seconds(id % 50) AS captured_at", "CAST(id % 3 AS INT) AS block")
    plain = at_addresses(rows, pages, ("block",))
    name = "captures_in_two_parts"
    land(pages.where("block < 2"), table=name)
    landed = at_addresses(rows, land(pages.where("block = 2"), table=name), ("block",))
    columns = sorted(plain.columns)
    assert sorted(landed.columns) == columns
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, landed.select(columns).collect()))
    spark.sql(f"DROP TABLE {name}")


def _moved(text):
    """Exchanges and sorts of a plan that carry a body."""
    return [line for line in text.splitlines() if ("Exchange" in line or "Sort " in line) and "body" in line]


@pytest.mark.parametrize("name", ["batch_alerts", "ir_items", "sources_to_alerts"])
def test_no_body_is_shuffled_or_sorted(spark, no_broadcast, name, monkeypatch):  # noqa: F811
    plans = []
    for module in (watchers,):
        whole = module.stage
        monkeypatch.setattr(module, "stage", lambda frame, purpose, whole=whole: plans.append(plan(frame, "simple")) or whole(frame, purpose))
    plans.append(plan(queries()[name](spark, SF), "simple"))
    joined = [text for text in plans if "ShuffledHashJoin" in text]
    assert joined
    # What is rendered for the test from other tables is built before it is landed.
    assert [line for text in joined for line in _moved(text)] == []


@pytest.mark.parametrize("name, parses", [("london_items", 2), ("sources_to_alerts", 4)])
def test_each_page_of_a_source_is_parsed_once(spark, name, parses, monkeypatch):
    """List pages and article dates of London; beside these, pages of issuers and articles."""
    plans = []
    whole = watchers.stage
    monkeypatch.setattr(watchers, "stage", lambda frame, purpose: plans.append(plan(frame, "simple")) or whole(frame, purpose))
    plans.append(plan(queries()[name](spark, SF), "simple"))
    assert sum(text.count("ArrowEvalPython") for text in plans) == parses


def test_all_sources_are_shown_and_the_earlier_one_wins(spark):
    rows = queries()["sources_to_alerts"](spark, SF).select("url", "source").collect()
    by_source = {s: {r["url"] for r in rows if r["source"] == s} for s in ("edgar", "lse", "ir")}
    assert all(by_source.values()) and len({r["url"] for r in rows}) == len(rows)
    # Fed by both: in the list where it was reached, in the feed alone where it was not.
    both = {u for u in by_source["lse"] if int(u.rsplit("/", 1)[1]) % 5 == 1}
    assert both and any("londonstockexchange" in u for u in by_source["ir"])


def test_items_far_apart_keep_their_order(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0, 4_096), (1, 0, 1, 1, 0), (67_108_864, 0, 1, 4_096, 3), (67_108_865, 1, 2, 0, 0)],
                                 "position long, part int, page int, block long, pos long")
    index = [r[0] for r in rows.select(watchers.item_index("position", "part", "page", "block", "pos")).collect()]
    assert len(set(index)) == 4 and index == sorted(index)
    assert rows.orderBy(F.desc(watchers.item_index("position", "part", "page", "block", "pos"))).first()["position"] == 67_108_865

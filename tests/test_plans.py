"""Physical plans: what is read, shuffled, and kept out of Python."""

import contextlib
import io
from functools import partial

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidings.operators.joins import hot_key_join
from tidings.operators import filings as filing_ops, items as item_ops
from workload.queries import QUERIES
from workload.tables import filing_captures, raw, table

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"incremental_alerts"}))
def test_no_cross_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(queries()["corpus_kpi_scan"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan(queries()["first_source_wins"](spark, SF))


def test_form_filter_reaches_the_scan(spark):
    text = plan(filing_ops.with_forms(spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_orderpriority", "form")))
    assert "PushedFilters: [In(o_orderpriority" in text


def test_first_wins_reduces_before_the_shuffle(spark):
    text = plan(item_ops.first_source_wins(item_ops.with_rank(table(spark, SF, "news_items"))), "simple")
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)
    assert text.count("Exchange") == 1


def test_ledger_join_reuses_the_partitioning(spark, no_broadcast):
    once = item_ops.first_source_wins(item_ops.with_rank(table(spark, SF, "news_items")))
    seen = raw(spark, SF, "pages").select("url")
    text = plan(item_ops.unseen(once, seen), "simple")
    assert text.count("Exchange hashpartitioning") == 2


def test_document_choice_shuffles_each_side_once(spark, no_broadcast):
    text = plan(filing_ops.with_document(table(spark, SF, "filings"), filing_captures(spark, SF)), "simple")
    bodies = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "body" in line]
    assert not bodies
    join = text.index("SortMergeJoin")
    assert "Exchange" not in text[:join] and "ObjectHashAggregate" in text[join:]


@pytest.mark.parametrize("name", ["page_links", "rns_listing", "page_clean_text"])
def test_each_page_is_parsed_once(spark, name):
    assert plan(queries()[name](spark, SF), "simple").count("ArrowEvalPython") == 1


def test_only_hot_keys_are_repeated(spark):
    """Keys that are not hot keep their one row, however many partitions a shuffle has."""
    many = spark.range(50_000).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS k", "id AS r")
    few = many.select("k").distinct().withColumn("v", F.lit(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2048")
    try:
        joined = hot_key_join(many, few, ["k"], "inner", by=["r"], hot_rows=5_000)
        text = plan(joined, "simple")
        assert "TakeOrderedAndProject" in text
        assert joined.count() == 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", ["kpi_yoy", "report_period", "guidance_sentences", "summary_payload", "alert_text", "corpus_kpi_scan", "feed_entries"])
def test_text_work_stays_in_the_jvm(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.fixture
def many_partitions(spark, no_broadcast):
    """Shuffles as on a larger cluster, every partition kept."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_list_page_is_dealt_out(spark, many_partitions, monkeypatch):
    """One page holds a third of all items; no task gets them all."""
    items = spark.range(0, 60000, 1, 8).selectExpr(
        "id AS item_idx", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('E', id % 5000) END AS epic",
        "CASE WHEN id % 3 = 0 THEN 1 ELSE CAST(1 + id % 2 AS INT) END AS page_no",
        "concat('https://x/', id) AS url", "'Results' AS title", "TIMESTAMP '2024-01-30' AS published_at")
    pages = items.select("epic", "page_no").distinct().selectExpr("*", "200 AS status")
    monkeypatch.setattr(item_ops, "hot_key_join", partial(hot_key_join, hot_rows=2_000))
    kept = item_ops.paged_items(pages, items, "2024-01-31", 14, 2)
    assert kept.count() == 60000
    assert largest_share(kept) < 0.2


def test_hot_issuer_is_dealt_out(spark, many_partitions, monkeypatch):
    filings = spark.range(0, 30000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN '7' ELSE CAST(id % 500 AS STRING) END AS cik10", "CAST(id AS STRING) AS accession")
    issuers = spark.range(500).selectExpr("CAST(id AS STRING) AS cik10", "'n' AS name", "'t' AS ticker")
    monkeypatch.setattr(filing_ops, "hot_key_join", partial(hot_key_join, hot_rows=1_000))
    joined = filing_ops.with_issuer(filings, issuers)
    assert joined.count() == 30000
    assert largest_share(joined) < 0.2


def test_hot_address_costs_one_row_per_task(spark):
    """Addresses repeated without end are reduced to one row per task before the shuffle."""
    items = spark.range(0, 60000, 1, 8).selectExpr(
        "id AS item_idx", "0 AS source_rank", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS url")
    once = item_ops.first_source_wins(items)
    assert once.count() == 40001 and once.filter("url = 'hot'").first().item_idx == 0

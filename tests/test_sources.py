"""Sources run apart, ledgers cut into byte ranges, ordered outboxes, and the function of tables."""

import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.test_plans import plan
from tidings.plans import cycle
from tidings.sources import ledger
from tidings.sources.registry import Source, collected_items
from tidings.sources.table_functions import register
from tidings.streaming.incremental import ITEMS


def items(spark, *urls):
    return spark.createDataFrame([("x", 9, i, "E", 1, u, "Results", None) for i, u in enumerate(urls)], ITEMS)


def test_a_source_that_fails_while_it_runs_leaves_the_others_whole(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("no parquet file")

    def unplanned(_spark, _as_of):
        raise OSError("not landed")

    sources = [
        Source("good", 0, lambda s, _: items(s, "a", "", None, "b")), Source("damaged", 1, lambda s, _: s.read.schema(ITEMS).parquet(str(tmp_path))),
        Source("unplanned", 2, unplanned), Source("off", 3, unplanned), Source("empty", 4, lambda s, _: items(s, "x").where("false"))]
    found, report = collected_items(spark, sources, "2024-01-31", enabled=["good", "damaged", "unplanned", "empty"])
    assert sorted((r["source"], r["source_rank"], r["url"]) for r in found.collect()) == [("good", 0, "a"), ("good", 0, "b")]
    rows = {r["source"]: r for r in report.collect()}
    assert (rows["good"]["status"], rows["good"]["valid"], rows["good"]["malformed"]) == ("ok", 2, 2)
    assert (rows["empty"]["status"], rows["empty"]["valid"], rows["empty"]["malformed"]) == ("ok", 0, 0)
    assert rows["damaged"]["status"] == rows["unplanned"]["status"] == "failed" and "not landed" in rows["unplanned"]["error"]
    assert "off" not in rows


def test_no_source_at_all(spark):
    found, report = collected_items(spark, [], "2024-01-31")
    assert found.count() == report.count() == 0


@pytest.mark.parametrize("width", [40, 1_000, 10_000_000])
def test_ledger_arrays_in_ranges_of_any_width(spark, tmp_path, width):
    r = random.Random(width)
    parts = ["https://x/", 'a"b', "\\", '\\"', ",", "[", "]", " ", "é", "中", "\n", "\t", "q=1", '",', "\\\\"]
    documents = [[r.choice([None, 7, True, "", *("".join(r.choices(parts, k=r.randrange(1, 9))) for _ in range(12))]) for _ in range(n)] for n in (0, 1, 30, 200)]
    for i, document in enumerate(documents):
        (tmp_path / f"ledger{i}.json").write_text(json.dumps(document, ensure_ascii=i % 2 == 0, indent=[None, 1][i // 2]), encoding="utf-8")
    expected = {x for document in documents for x in document if isinstance(x, str)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = ledger.read_ledger_arrays(spark, str(tmp_path))
        rows = [row["url"] for row in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected
        if width == 40:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ledger_arrays_that_are_broken_off(spark, tmp_path):
    (tmp_path / "a.json").write_text('["one", "two", "thr')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text('["bad \\x escape", "four"]')
    assert {r["url"] for r in ledger.read_ledger_arrays(spark, str(tmp_path)).collect()} == {"one", "two", "four"}


def test_outbox_files_follow_the_order_of_display(spark, tmp_path):
    rows = spark.range(0, 5_000, 1, 7).select(
        (F.pmod(F.xxhash64("id"), F.lit(3))).cast("int").alias("source_rank"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10**9)).alias("item_idx"), "id")
    path = str(tmp_path / "outbox")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cycle.save_in_order(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted((tmp_path / "outbox").glob("part-*.parquet"))
    assert len(files) > 3
    shown = [[tuple(r) for r in spark.read.parquet(str(f)).select("source_rank", "item_idx").collect()] for f in files]
    every = [r for rows_of_file in shown for r in rows_of_file]
    assert every == sorted(every) and len(every) == 5_000
    placed = cycle.read_in_order(spark, path).orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(1, 5_001))
    assert [(r["source_rank"], r["item_idx"]) for r in placed] == every


def test_function_of_tables_keeps_the_columns_it_is_given(spark):
    register(spark)
    spark.createDataFrame([(1, "https://h/a", "<li><a href='x'>X</a><time>1 May 2025</time></li>", {"k": 1}), (2, None, None, None)],
                          "n int, url string, body string, m map<string,int>").createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT * FROM ir_pages(TABLE(some_pages))")
    assert found.columns == ["n", "url", "m", "item_url", "title", "date_texts"]
    assert [tuple(r) for r in found.collect()] == [(1, "https://h/a", {"k": 1}, "https://h/x", "X", ["1 May 2025"])]
    assert "Exchange" not in plan(spark.sql("SELECT n, title FROM ir_pages(TABLE(some_pages))"), "simple")
    with pytest.raises(AnalysisException, match="lacks body"):
        spark.sql("SELECT * FROM ir_pages(TABLE(SELECT n, url FROM some_pages))")

"""The ledger in buckets: runs, merging, replays, and what a lookup reads."""

import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from tidings.sources.handled import Handled, Run


def urls(spark, numbers):
    return spark.createDataFrame([(f"https://x/{n}",) for n in numbers], "url string")


def known(ledger, **how):
    return sorted(int(r["url"].rsplit("/", 1)[1]) for r in ledger.addresses(**how).collect())


def test_runs_are_merged_by_level_and_hold_the_same(spark, tmp_path):
    ledger = Handled(spark, str(tmp_path / "handled"), buckets=4, fan=3)
    for batch in range(14):
        ledger.add(urls(spark, [2 * batch, 2 * batch + 1]), "news", batch)
        ledger.merge("news", batch)
        assert known(ledger) == list(range(2 * batch + 2))
        # At most fan + 1 runs of the lowest level (the newest cannot be merged yet), and fewer than fan of the others.
        assert all(sum(run.level == level for run in ledger.live()) <= 3 + (level == 0) for level in range(4))
    assert {run.level for run in ledger.live()} >= {0, 1}
    assert ledger.last("news") == 13 and ledger.last("other") == -1


def test_a_replayed_batch_replaces_its_own_and_does_not_see_it(spark, tmp_path):
    ledger = Handled(spark, str(tmp_path / "handled"), buckets=4)
    ledger.add(urls(spark, [1, 2]), "news", 0)
    ledger.add(urls(spark, [3, 4]), "news", 1)
    ledger.add(urls(spark, [9]), "other", 5)
    rows = urls(spark, [1, 3, 5, 9])
    assert [r["url"][-1] for r in ledger.unseen(rows).orderBy("url").collect()] == ["5"]
    assert [r["url"][-1] for r in ledger.unseen(rows, "news", 1).orderBy("url").collect()] == ["3", "5"]
    ledger.add(urls(spark, [5]), "news", 1)
    assert known(ledger) == [1, 2, 5, 9]


def test_a_run_that_broke_off_does_not_count(spark, tmp_path):
    base = tmp_path / "handled"
    ledger = Handled(spark, str(base), buckets=4, fan=2)
    for batch in range(2):
        ledger.add(urls(spark, [batch]), "news", batch)
    ledger._write(urls(spark, [77]), Run("news", 1, 0, 1))
    (base / "news.1.0-1" / "_SUCCESS").unlink()
    assert known(ledger) == [0, 1]
    ledger.merge("news", 2)
    assert known(ledger) == [0, 1] and [run.level for run in ledger.live()] == [1]
    # Covered runs go with the next merge, when no reader holds them any more.
    assert len(ledger.committed()) == 3
    ledger.merge("news", 2)
    assert len(ledger.committed()) == 1


def test_empty_ledgers_and_null_addresses(spark, tmp_path):
    ledger = Handled(spark, str(tmp_path / "handled"))
    assert ledger.unseen(urls(spark, [1])).count() == 1
    ledger.add(spark.createDataFrame([(None,)], "url string"), "news", 0)
    assert ledger.addresses().count() == 0 and ledger.last("news") == 0
    assert ledger.unseen(spark.createDataFrame([(None,), ("a",)], "url string")).count() == 2


@pytest.mark.parametrize("batch", [1, 3])
def test_a_lookup_reads_the_batch_s_buckets_only(spark, tmp_path, batch):
    ledger = Handled(spark, str(tmp_path / "handled"), buckets=32)
    ledger.add(urls(spark, range(2_000)), "news", 0)
    rows = urls(spark, range(1_990, 1_990 + batch))
    found = ledger.among(rows)
    assert "dynamicpruning" in plan(found)
    wanted = {r[0] for r in rows.select(ledger.bucket(F.col("url"))).collect()}
    read = {int(r[0].split("bucket=")[1].split("/")[0]) for r in found.select(F.input_file_name()).distinct().collect()}
    assert read == wanted and len(read) <= batch
    scanned = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scanned or "dynamicpruningexpression" in scanned

"""Screening, first-wins, paging, ledger and article dates."""

from datetime import datetime

from pyspark.sql import Observation

from tidings.operators import items as ops
from tidings.sources import ledger
from tidings.sources.registry import Source, all_items

AS_OF = "2024-01-31 12:00:00"
SCHEMA = ("source string, source_rank int, item_idx bigint, epic string, page_no int,"
          " url string, title string, published_at timestamp")


def item(idx, url="u", title="Results", at=None, source="lse", rank=1, epic="A", page=1):
    return (source, rank, idx, epic, page, url, title, at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return sorted(r.item_idx for r in df.select("item_idx").collect())


def test_validity_and_quarantine(spark):
    df = frame(spark, item(1), item(2, url=""), item(3, url=None), item(4, title=None))
    assert ids(ops.valid_items(df)) == [1, 4]
    assert ids(ops.quarantined_items(df)) == [2, 3]
    assert ops.valid_items(df).filter("item_idx = 4").first().title == ""
    seen = Observation("counts")
    ops.counted(df, seen).collect()
    assert seen.get == {"valid": 2, "malformed": 2}


def test_keywords(spark):
    df = frame(spark, item(1, title="HALF year"), item(2, title="We notify you"), item(3, title="Annual Report"),
               item(4, title="Preliminary"), item(5, title=None), item(6, title="Board"))
    assert ids(ops.rns_titles(df)) == [1, 2, 4]
    assert ids(ops.ir_titles(df)) == [1, 2, 3]
    assert ids(ops.ir_titles(df, "board")) == [6]


def test_window_keeps_undated_and_the_edge(spark):
    df = frame(spark, item(1), item(2, at=datetime(2024, 1, 21, 12)), item(3, at=datetime(2024, 1, 21, 11, 59)))
    assert ids(ops.in_window(df, AS_OF, 10)) == [1, 2]


def test_first_source_wins_and_is_idempotent(spark):
    df = frame(spark, item(7, "a", "ir", source="ir", rank=2), item(9, "a", "lse"), item(8, "a", "lse first"), item(1, "b"))
    once = ops.first_source_wins(df)
    assert ids(once) == [1, 8]
    assert ids(ops.first_source_wins(once)) == [1, 8]


def test_unseen(spark):
    df = frame(spark, item(1, "a"), item(2, "b"))
    seen = spark.createDataFrame([("a",), (None,)], "url string")
    assert ids(ops.unseen(df, seen)) == [2]


OLD, NEW = datetime(2024, 1, 1), datetime(2024, 1, 30)


def reached(spark, pages, *rows, max_pages=3):
    listed = spark.createDataFrame([("A", n, status) for n, status in pages], "epic string, page_no int, status int")
    got = ops.read_pages(listed, frame(spark, *rows), AS_OF, 10, max_pages)
    return sorted(r.page_no for r in got.collect())


def test_paging_stops_after_an_old_page(spark):
    ok = [(1, 200), (2, 200), (3, 200)]
    assert reached(spark, ok, item(1, at=OLD), item(2, at=NEW, page=2)) == [1]
    assert reached(spark, ok, item(1, at=OLD), item(2), item(3, at=NEW, page=2), item(4, at=NEW, page=3)) == [1, 2, 3]
    assert reached(spark, ok, item(1, at=NEW), item(2, at=OLD, page=2), item(3, at=NEW, page=3)) == [1, 2]


def test_empty_page_stops_and_failed_page_does_not(spark):
    rows = (item(1, at=NEW), item(3, at=NEW, page=3))
    assert reached(spark, [(1, 200), (2, 200), (3, 200)], *rows) == [1, 2]
    assert reached(spark, [(1, 200), (2, 500), (3, 200)], *rows) == [1, 3]
    assert reached(spark, [(1, 200), (2, 200), (3, 200)], item(2, at=NEW, page=2), max_pages=2) == [1]


def test_paged_items_leave_failed_and_unreached_pages_out(spark):
    listed = spark.createDataFrame([("A", 1, 200), ("A", 2, 404)], "epic string, page_no int, status int")
    df = frame(spark, item(1, at=NEW), item(2, at=NEW, page=2), item(3, at=NEW, page=3))
    assert ids(ops.paged_items(listed, df, AS_OF, 10, 3)) == [1]


def test_detail_dates_fill_only_undated_keyword_items(spark):
    df = frame(spark, item(1, "a"), item(2, "a"), item(3, "b"), item(4, "a", title="Board"), item(5, "a", at=OLD), item(6, "c"))
    captures = spark.createDataFrame([
        ("a", 200, "<time>5 Jan 2024</time>"), ("b", 404, "<time>5 Jan 2024</time>"), ("c", 200, "<p>none")],
        "url string, status int, body string")
    got = {r.item_idx: r.published_at for r in ops.with_detail_dates(df, captures).collect()}
    assert got == {1: datetime(2024, 1, 5), 2: datetime(2024, 1, 5), 3: None, 4: None, 5: OLD, 6: None}


def test_sources_and_switches(spark):
    def read(name):
        return lambda session, as_of: frame(session, item(1, url=name, source="?", rank=9)).drop("source", "source_rank")

    sources = [Source("edgar", 0, read("e")), Source("ir", 2, read("i"))]
    rows = all_items(spark, sources, AS_OF).collect()
    assert sorted((r.source, r.source_rank, r.url) for r in rows) == [("edgar", 0, "e"), ("ir", 2, "i")]
    assert [r.source for r in all_items(spark, sources, AS_OF, ["ir"]).collect()] == ["ir"]
    assert all_items(spark, sources, AS_OF, []).count() == 0
    df = frame(spark, item(1), item(2, source="ir"))
    assert ids(ops.enabled(df, ["ir"])) == [2] and ids(ops.enabled(df, [])) == []


def test_ledger_formats(spark, tmp_path):
    for name, raw in {"array": b'["a", "b", 1]\n', "object": b'{"seen": ["c"], "x": 1}', "lines": b" d \r\n\n e\n",
                      "other": b'{"x": 1}', "broken": b'["f", ', "trailing": b'["g"] x', "brace": b"} h",
                      "binary": b"\xff\xfei\n", "empty": b""}.items():
        (tmp_path / name).write_bytes(raw)
    keys = sorted(r.url for r in ledger.read_ledger(spark, str(tmp_path)).collect())
    assert keys == sorted(["a", "b", "1", "c", "d ", " e"])


def test_ledger_round_trip(spark, tmp_path):
    one, two = (spark.createDataFrame([(u,) for u in us], "url string") for us in (["b", "a", "a"], ["c", "a"]))
    ledger.save_ledger(ledger.merged(one, two), f"{tmp_path}/saved")
    ledger.export_ledger(one, f"{tmp_path}/out")
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/saved").collect()) == ["a", "b", "c"]
    assert spark.read.json(f"{tmp_path}/out").count() == 2

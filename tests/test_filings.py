"""Issuers, submissions and the choice of a filing's document."""

import json

import pytest

from tidings.operators import filings as ops
from tidings.sources import feeds, filings as sources
from tidings.sources.listings import expected_list_pages, ir_items

ISSUERS = "position int, name string, ticker string, cik string"


def test_unique_issuers(spark):
    rows = [(1, "A", "aa", None), (2, "B", "AA", None), (3, "C", "aa", "7"), (4, "D", None, None), (5, "E", "", "7"), (6, "F", "ff", "0")]
    got = ops.unique_issuers(spark.createDataFrame(rows, ISSUERS))
    assert sorted(r.name for r in got.collect()) == ["A", "C", "F"]


def test_issuer_list_puts_bare_tickers_last(spark):
    listed = spark.createDataFrame([(5, "A", "aa", None)], ISSUERS)
    bare = spark.createDataFrame([(1, " AA "), (2, "bb"), (3, " ")], "position int, ticker string")
    got = ops.unique_issuers(sources.issuer_list(listed, bare))
    assert sorted((r.ticker, r.name) for r in got.collect()) == [("aa", "A"), ("bb", None)]


def test_resolution(spark):
    issuers = spark.createDataFrame([(1, "A", "AA", None), (2, "B", "bb", "12"), (3, "C", "cc", None), (4, "D", None, None)], ISSUERS)
    tickers = spark.createDataFrame([("aa", "0000000099"), ("bb", "0000000001")], "ticker_key string, cik10 string")
    got = {r.name: r.cik10 for r in ops.resolved_issuers(issuers, tickers).collect()}
    assert got == {"A": "0000000099", "B": "0000000012"}


def test_ir_issuers_flatten(spark):
    rows = spark.createDataFrame(
        [("A", "a", ("r", None, None, None)), ("B", "b", None)],
        "name string, ticker string, ir struct<rss:string,page:string,item_selector:string,date_selector:string>")
    assert [(r.name, r.rss, r.page) for r in sources.ir_issuers(rows).orderBy("name").collect()] == [("A", "r", None), ("B", None, None)]


def test_directory_last_duplicate_wins(spark):
    body = json.dumps({"0": {"cik_str": 1, "ticker": "AB"}, "1": {"cik_str": "22", "ticker": "ab"}, "2": {"cik_str": 3, "ticker": "C"}})
    rows = spark.createDataFrame([(1, body), (2, "not json")], "directory_id int, body string")
    assert {r.ticker_key: r.cik10 for r in sources.ticker_map(rows).collect()} == {"ab": "0000000022", "c": "0000000003"}


def test_submissions_stop_at_the_shortest(spark):
    def doc(**arrays):
        return json.dumps({"filings": {"recent": arrays}})

    rows = spark.createDataFrame([
        ("1", doc(form=["8-K", "10-Q", "10-K"], filingDate=["a", "b"], accessionNumber=["x", "y", "z"], primaryDocument=["p", "q", "r"])),
        ("2", doc(form=["8-K"])), ("3", "{}"), ("4", "broken")], "cik10 string, body string")
    got = sources.filings(rows).orderBy("pos").collect()
    assert [(r.cik10, r.pos, r.form, r.filing_date, r.primary_doc) for r in got] == [("1", 0, "8-K", "a", "p"), ("1", 1, "10-Q", "b", "q")]


def test_forms_and_window(spark):
    rows = spark.createDataFrame([("8-K", "2024-01-21"), ("8-K", "2024-01-22"), ("8-k", "2024-01-30"), ("8-K", "soon")], "form string, filing_date string")
    kept = ops.filed_in_window(ops.with_forms(rows), "2024-01-31 12:00:00", 10)
    assert [r.filing_date for r in kept.collect()] == ["2024-01-22"]
    assert ops.override_forms(" 8-k, ,S-1") == ("8-K", "S-1")


def test_title(spark):
    rows = spark.createDataFrame([("8-K", "T", "N", "d"), ("8-K", "", "N", "d"), ("8-K", None, None, "d")], "form string, ticker string, name string, filing_date string")
    assert [r[0] for r in rows.select(ops.filing_title()).collect()] == ["8-K T (d)", "8-K N (d)", "8-K (d)"]


FOLDER = "https://www.sec.gov/Archives/edgar/data/7/1/"
EX = '<a href="ex.htm">Exhibit-99.1</a>'


@pytest.mark.parametrize("form, primary, index, expected", [
    ("10-Q", "text", None, "p.htm"),
    ("8-K", "Item 2.02", None, "p.htm"),
    ("8-K", "other", EX, "ex.htm"),
    ("8-K", "other", '<a href="/Archives/x.htm"> EX 99.1', "https://www.sec.gov/Archives/x.htm"),
    ("8-K", "other", "no link", "p.htm"),
    ("8-K", "other", None, None),
    ("8-K", None, EX, "1-index.html"),
    ("10-K", None, "any", "1-index.html"),
    ("10-K", None, None, None),
])
def test_document_choice(spark, form, primary, index, expected):
    filings = spark.createDataFrame([(form, "0000000007", "1", "p.htm")], "form string, cik10 string, accession string, primary_doc string")
    captures = [(FOLDER + "p.htm", 200 if primary is not None else 404, primary or ""),
                (FOLDER + "1-index.html", 200 if index is not None else 503, index or ""),
                (FOLDER + "noise.htm", 200, EX)]
    got = ops.with_document(filings, spark.createDataFrame(captures, "url string, status int, body string")).collect()
    full = expected and (expected if expected.startswith("http") else FOLDER + expected)
    assert [r.url for r in got] == ([full] if full else [])


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>
<item><title> Q1 &amp; results </title><link>https://a/1?x=1&amp;y=2</link><pubDate>Wed, 02 Oct 2002 13:00:00 GMT</pubDate></item>
<item><title>No link</title></item><item><title></title><link>https://a/2</link></item>
<item><title>DC</title><link>https://a/3</link><dc:date>2002-10-03T23:30:00-01:00</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>E</title><link rel="self" href="https://a/s"/>
<link href="https://a/4"/><updated>2002-10-05T10:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    rows = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<rss><broken"), (4, None)], "id int, body string")
    got = feeds.feed_items(rows).orderBy("id", "pos").collect()
    assert [(r.id, r.title, r.item_url, str(r.published_at)) for r in got] == [
        (1, "Q1 & results", "https://a/1?x=1&y=2", "2002-10-02 00:00:00"),
        (1, "DC", "https://a/3", "2002-10-04 00:00:00"),
        (2, "E", "https://a/4", "2002-10-05 00:00:00")]


def test_ir_items_feed_then_page(spark):
    issuers = spark.createDataFrame(
        [("A", "https://h/rss", "https://h/ir/", None, None), ("B", None, "https://g/ir", ".hit a", ".when")],
        "issuer_id string, rss string, page string, item_selector string, date_selector string")
    captures = spark.createDataFrame([
        ("https://h/rss", "https://h/rss", 200, RSS),
        ("https://h/ir/", "https://h/ir/", 200, "<article><a href='n'>N</a></article>"),
        ("https://g/ir", "https://g/ir", 200, "<p class=hit><a href='m'>M</a><i class=when>May 3, 2024</i></p><p><a href='o'>O</a>")],
        "url string, final_url string, status int, body string")
    got = ir_items(issuers, captures).orderBy("issuer_id", "part", "pos").collect()
    assert [(r.issuer_id, r.part, r.item_url, str(r.published_at)) for r in got] == [
        ("A", 0, "https://a/1?x=1&y=2", "2002-10-02 00:00:00"), ("A", 0, "https://a/3", "2002-10-04 00:00:00"),
        ("A", 1, "https://h/ir/n", "None"), ("B", 1, "https://g/m", "2024-05-03 00:00:00")]


def test_expected_list_pages(spark):
    pages = expected_list_pages(spark.createDataFrame([("ABC",)], "epic string"), 2, "https://h").orderBy("page_no").collect()
    assert [r.url for r in pages] == ["https://h/stock/ABC/company-news?page=1", "https://h/stock/ABC/company-news?page=2"]


def test_table_function(spark):
    from tidings.sources.table_functions import register

    register(spark)
    spark.createDataFrame([("https://h/ir/", "<li><a href='n'>N</a></li>")], "url string, body string").createOrReplaceTempView("landed")
    got = spark.sql("SELECT l.item_url, l.title FROM landed c LATERAL VIEW inline(ir_links(c.body, c.url)) l").collect()
    assert [tuple(r) for r in got] == [("https://h/ir/n", "N")]

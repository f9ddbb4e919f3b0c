"""Disclosure-shaped inputs derived from the given tables.

Each entry is (source table, {column: SQL expression}, WHERE or None) in SQL
that means the same to Spark and DuckDB, so queries and their checks start from
the same rows. All are projections: they grow with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.session import spread

_NEWS_URL = "concat('https://ir.example.com/', CAST(user_id AS STRING), '/', CAST(event_id % 37 AS STRING))"
_CIK = "CAST(o_custkey + 320000 AS STRING)"
_ACCESSION = (
    f"concat(lpad({_CIK}, 10, '0'), '-', substr(CAST(o_orderdate AS STRING), 3, 2), '-',"
    " lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'))"
)
_FOLDER = f"concat('https://www.sec.gov/Archives/edgar/data/', {_CIK}, '/', replace({_ACCESSION}, '-', ''), '/')"

TABLES = {
    "issuers": ("customer", {
        "issuer_id": "c_custkey",
        "name": "c_name",
        "ticker": "CASE WHEN c_custkey % 5 <> 0 THEN concat('T', CAST(c_custkey AS STRING)) END",
        "cik": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 320000 END",
    }, None),
    "ticker_map": ("customer", {
        "ticker_key": "lower(concat('T', CAST(c_custkey AS STRING)))",
        "cik10": "lpad(CAST(c_custkey + 320000 AS STRING), 10, '0')",
    }, "c_custkey % 7 <> 0"),
    "filings": ("orders", {
        "filing_id": "o_orderkey",
        "issuer_id": "o_custkey",
        "cik10": f"lpad({_CIK}, 10, '0')",
        "form": "CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-Q'"
                " WHEN '3-MEDIUM' THEN '10-K' WHEN '4-NOT SPECIFIED' THEN '6-K' ELSE 'SC 13G' END",
        "filing_date": "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END",
        "accession": _ACCESSION,
        "primary_doc": "concat('d', CAST(o_orderkey AS STRING), '.htm')",
    }, None),
    "primary_captures": ("orders", {
        "url": f"concat({_FOLDER}, 'd', CAST(o_orderkey AS STRING), '.htm')",
        "status": "CASE WHEN o_orderkey % 10 = 0 THEN 404 ELSE 200 END",
        "body": "CASE WHEN o_orderkey % 3 = 0 THEN 'Item 2.02 Results of Operations' ELSE 'Item 8.01 Other Events' END",
    }, None),
    "index_captures": ("orders", {
        "url": f"concat({_FOLDER}, {_ACCESSION}, '-index.html')",
        "status": "CASE WHEN o_orderkey % 4 = 0 THEN 404 ELSE 200 END",
        "body": "CASE WHEN o_orderkey % 2 = 1 THEN concat('<a href=\"ex991-', CAST(o_orderkey AS STRING),"
                " '.htm\">EX-99.1</a>') ELSE '<a href=\"x.htm\">EX-10</a>' END",
    }, None),
    "news_items": ("events", {
        "item_idx": "event_id",
        "source": "CASE event_type WHEN 'click' THEN 'edgar' WHEN 'view' THEN 'lse' ELSE 'ir' END",
        "epic": "concat('E', CAST(user_id AS STRING))",
        "page_no": "1 + CAST(floor((30 - day(ts)) / 10.0) AS INT)",
        "url": f"CASE WHEN event_id % 101 = 0 THEN '' ELSE {_NEWS_URL} END",
        "title": "CASE event_id % 6 WHEN 0 THEN 'Q3 2023 Results' WHEN 1 THEN 'Trading Update'"
                 " WHEN 2 THEN 'Board change' WHEN 3 THEN 'Half-Year report'"
                 " WHEN 4 THEN 'Directorate notice' ELSE '' END",
        "published_at": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END",
    }, None),
    "news_slices": ("events", {
        "item_idx": "event_id",
        "slice": "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END",
    }, None),
    "event_times": ("events", {
        "event_id": "event_id", "user_id": "user_id", "event_type": "event_type",
        "ts": "CAST(ts AS TIMESTAMP)", "url": _NEWS_URL,
    }, None),
    "announcements": ("orders", {
        "doc_id": "o_orderkey",
        "url": "concat('https://ir.example.com/doc/', CAST(o_orderkey AS STRING))",
        "title": "CASE o_orderkey % 5 WHEN 0 THEN concat('Q', CAST(o_orderkey % 4 + 1 AS STRING), ' ',"
                 " CAST(2020 + o_orderkey % 6 AS STRING), ' Results')"
                 " WHEN 1 THEN 'Interim statement' WHEN 2 THEN concat('FY', CAST(2020 + o_orderkey % 6 AS STRING), ' report')"
                 " WHEN 3 THEN NULL ELSE 'Trading update' END",
        "text": """concat('The company reports third quarter ', CAST(2020 + o_orderkey % 6 AS STRING), ' trading. ',
          CASE WHEN o_orderkey % 10 IN (0, 1, 2, 3) THEN concat('Total revenue was $', CAST(o_orderkey % 900 + 1 AS STRING), '.5 million, prior year up ', CAST(o_orderkey % 60 AS STRING), '.2%. ')
               WHEN o_orderkey % 10 IN (4, 5) THEN concat('Revenue of 1,', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ' bn, increased ', CAST(o_orderkey % 60 AS STRING), '%. ')
               ELSE '' END,
          CASE WHEN o_orderkey % 10 IN (0, 2, 4, 6) THEN concat('Adjusted EBITDA of £', CAST(o_orderkey % 300 AS STRING), ' m, rose ', CAST(o_orderkey % 40 AS STRING), '%. ') ELSE '' END,
          CASE WHEN o_orderkey % 10 IN (0, 7) THEN concat('Net loss of €-', CAST(o_orderkey % 80 AS STRING), ' million. ') ELSE '' END,
          CASE WHEN o_orderkey % 10 IN (0, 3, 8) THEN concat('Adjusted diluted EPS $0.', CAST(o_orderkey % 90 + 10 AS STRING), '. ') ELSE '' END,
          CASE WHEN o_orderkey % 10 IN (1, 2) THEN 'Management raised guidance for next year. The outlook is stable. '
               WHEN o_orderkey % 10 = 9 THEN concat('Management raised guidance for next year. ', repeat('No other change to report. ', 10), 'The outlook is stable. ') ELSE '' END,
          'Contact the office.')""",
    }, None),
    "captures": ("pages", {
        "page_id": "page_id", "url": "url", "final_url": "url", "content_type": "'text/html'",
        "status": "CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END", "body": "html",
    }, None),
    # The given prose, whole, with a results paragraph in front of every third text.
    "corpus": ("documents", {
        "doc_id": "doc_id",
        "text": "CASE WHEN doc_id % 3 = 0 THEN concat('The company reports third quarter ', CAST(2020 + doc_id % 6 AS STRING),"
                " ' trading. Total revenue was $', CAST(doc_id % 900 + 1 AS STRING), '.5 million, prior year up ', CAST(doc_id % 60 AS STRING),"
                " '.2%. Adjusted EBITDA of £', CAST(doc_id % 300 AS STRING), ' m, rose ', CAST(doc_id % 40 AS STRING), '%. Net loss of €-',"
                " CAST(doc_id % 80 AS STRING), ' million. Adjusted diluted EPS $0.', CAST(doc_id % 90 + 10 AS STRING), '. ', text) ELSE text END",
    }, None),
    "seen_rows": ("events", {"user_id": "user_id", "url": _NEWS_URL}, "user_id % 9 = 0"),
}


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Tables whose rows are searched or parsed at length.
_HEAVY = ("announcements", "corpus", "captures", "primary_captures", "index_captures")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    source, columns, where = TABLES[name]
    rows = raw(spark, sf_dir, source)
    if name in _HEAVY:
        rows = spread(rows)
    if where:
        rows = rows.where(where)
    return rows.selectExpr(*[f"{sql} AS {column}" for column, sql in columns.items()])


def sliced_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items with the slice of days they land in."""
    source, columns, _ = TABLES["news_items"]
    named = {**columns, **TABLES["news_slices"][1]}
    return raw(spark, sf_dir, source).selectExpr(*[f"{sql} AS {column}" for column, sql in named.items()])


def cte(*names: str) -> str:
    """The same tables as leading common table expressions of an SQL text."""
    def one(name):
        source, columns, where = TABLES[name]
        shown = ", ".join(f"{sql} AS {column}" for column, sql in columns.items())
        return f"{name} AS (SELECT {shown} FROM {source}" + (f" WHERE {where}" if where else "") + ")"
    return "WITH " + ",\n".join(one(n) for n in names)


def filing_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary pages and index pages of all filings, keyed by address."""
    return table(spark, sf_dir, "primary_captures").unionByName(table(spark, sf_dir, "index_captures"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows; consumers need no distinct rows."""
    return table(spark, sf_dir, "seen_rows").select("url")

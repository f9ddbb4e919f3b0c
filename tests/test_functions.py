"""Dates, addresses, figures, periods and guidance on hand-written cases."""

import random
import re
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidings.fixed_values import GUIDANCE, GUIDANCE_TAIL
from tidings.functions.dates import date_text, filing_date, free_date, listed_date, token_date
from tidings.functions.figures import with_figures
from tidings.functions.narrative import guidance_sentences, with_period
from tidings.functions.text import comma_list, decode_entities, squash
from tidings.functions.urls import host_url, join_url, pad_cik


def column(spark, values, make, kind="string"):
    """``make`` applied to each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_listed_dates(spark):
    cases = {
        "21 Aug 2025 07:00": datetime(2025, 8, 21, 7),
        " 21 Aug 2025 ": datetime(2025, 8, 21),
        "1 sep 2025": datetime(2025, 9, 1),
        "2025-08-21T07:00:00Z": datetime(2025, 8, 21, 7),
        "2025-08-21T07:00:00+0100": datetime(2025, 8, 21, 6),
        "2025-08-21T07:00:00+01:00": datetime(2025, 8, 21, 6),
        "2025-08-21": datetime(2025, 8, 21),
        "2025-08-21T07:00:00": None,
        "2025-08-21T07:00:00.5Z": None,
        "31 Feb 2025": None,
        "21 August 2025": None,
        "": None,
        None: None,
    }
    assert column(spark, cases, listed_date) == list(cases.values())


def test_dates_from_tokens_in_any_order(spark):
    r = random.Random(11)
    months = ["Jan", "February", "mar", "Apr.", "May", "JUNE", "Jul", "August", "Sept", "Oct", "Nov", "dec"]
    cases = {}
    for _ in range(400):
        year, month, day = r.randrange(1990, 2040), r.randrange(1, 13), r.randrange(1, 29)
        hour, minute, second = r.choice([(0, 0, 0), (r.randrange(24), r.randrange(60), 0), (r.randrange(24), r.randrange(60), r.randrange(60))])
        suffix = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd"}.get(day, "th")
        date = [str(year), months[month - 1], r.choice([str(day), f"{day}{suffix}", f"the {day}{suffix} of"])]
        r.shuffle(date)
        shown, hours = "", 0
        if (hour, minute, second) != (0, 0, 0):
            seconds = f":{second:02d}" if second else ""
            shown = r.choice([f"{hour}:{minute:02d}{seconds}", f"{hour % 12 or 12}:{minute:02d}{seconds}{r.choice(['', ' '])}{'ap'[hour > 11]}m"])
            zone, hours = r.choice([("", 0), (" EST", -5), (" GMT", 0), (" +0200", 2), (" -03:00", -3), (" PDT", -7)])
            shown += zone
        text = r.choice(["", "Published ", "Thursday, "]) + r.choice(["{} at {}", "{}, {}", "{} | {} hours"]).format(" ".join(date), shown)
        if r.random() < 0.3:
            text = f"{shown} on {' '.join(date)} by staff"
        cases[text] = datetime(year, month, day, hour, minute, second) - timedelta(hours=hours)
    assert column(spark, cases, lambda c: token_date(date_text(c))) == list(cases.values())


def test_tokens_that_are_no_date(spark):
    cases = dict.fromkeys(["May 2025", "1 May", "10:30 on Monday", "1 of 12 in 2025", "31 Feb 2025", "13 pm May 2025 1st", "May I see 3.2025 of 12?", "", "2025 12 1"])
    cases |= {"2025 May 1st": datetime(2025, 5, 1), "7 am, the 2nd of June 2024": datetime(2024, 6, 2, 7), "2024 12 am Dec 3": datetime(2024, 12, 3)}
    assert column(spark, cases, lambda c: free_date(date_text(c))) == list(cases.values())


def test_free_dates(spark):
    cases = {
        "Wed, 02 Oct 2002 13:00:00 GMT": datetime(2002, 10, 2, 13),
        "Wed, 02 Oct 2002 13:00:00 +0200": datetime(2002, 10, 2, 11),
        "02 Oct 2002 13:00:00 EST": datetime(2002, 10, 2, 18),
        "Posted on 21 August 2025": datetime(2025, 8, 21),
        "August 21, 2025": datetime(2025, 8, 21),
        "Sept. 3, 2025 3:05 pm": datetime(2025, 9, 3, 15, 5),
        "2025-08-21T07:00:00.123+01:00": datetime(2025, 8, 21, 6, 0, 0, 123000),
        "2025-08-21 07:00": datetime(2025, 8, 21, 7),
        "2025/8/1": datetime(2025, 8, 1),
        "10/2/2002": datetime(2002, 10, 2),
        "25/12/2002": datetime(2002, 12, 25),
        "yesterday": None,
        None: None,
    }
    assert column(spark, cases, lambda c: free_date(date_text(c))) == list(cases.values())


def test_filing_dates(spark):
    assert column(spark, ["2001-08-01", "n/a", "2001-13-01", None], filing_date) == [
        datetime(2001, 8, 1), None, None, None]


def test_squash_takes_unicode_spaces(spark):
    assert column(spark, [" a \n b\t", ""], squash) == ["a b", ""]


def test_entities(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "caf&eacute; &amp; &#8217;": "café & ’", "plain": "plain", "AT&T": "AT&T", None: None}
    assert column(spark, cases, decode_entities) == list(cases.values())


def test_comma_list(spark):
    assert column(spark, [" a, ,b ,"], comma_list) == [["a", "b"]]


def test_host_and_cik(spark):
    assert column(spark, ["/a", "a", "http://x/y"], lambda c: host_url(c, "https://h")) == ["https://h/a", "https://h/a", "http://x/y"]
    assert column(spark, ["320193", "0000000007", "x", None, "12345678901"], pad_cik) == ["0000320193", "0000000007", None, None, "12345678901"]


HREFS = ["x.htm", "/x/y", "//other.org/z", "https://a.b/c", "../up", "./same", "a/../../b/./c", "../../../../top",
         "?q=1", "#part", "", "x/.", "x/..", "a?b=/../c", "mailto:x@y.z"]


@pytest.mark.parametrize("base", ["https://h.com/a/b/c.html", "https://h.com/a/b/", "https://h.com", "https://h.com/p?q=/x/#f"])
def test_join_url_is_rfc_3986(spark, base):
    assert column(spark, HREFS, lambda c: join_url(F.lit(base), c)) == [urljoin(base, h) for h in HREFS]


def figures(spark, text, metric):
    row = with_figures(spark.createDataFrame([(text,)], "text string"), metrics=(metric,)).first()[metric]
    return (row.current, row.yoy) if row else None


@pytest.mark.parametrize("metric, text, expected", [
    ("eps", "EPS of $0.45", ("$0.45", None)),
    ("eps", "diluted EPS 0.45", ("0.45", None)),
    ("net_income", "Net loss $5m", ("$5m", None)),
    ("revenue", "revenue 1234", ("1234", None)),
    ("revenue", "Q3 revenue for 2024 was 1,234.", ("1,234", None)),
    ("revenue", "revenue rose 12%", None),
    ("revenue", "revenue rose 12% to $11.5 million, prior year up 3.2%", ("$11.5 million", "up 3.2%")),
    ("revenue", "Revenue was £5 m. It grew 7 % on last year.", ("£5 m", "grew 7 %")),
    ("revenue", "prior year 4.5%. Total revenue of 1,050 bn", ("1,050 bn", "4.5%")),
    ("ebitda", "Adjusted EBITDA (unaudited) €-12.5 mn", ("€-12.5 mn", None)),
    ("revenue", "no figure for revenues here 5", None),
    ("revenue", "revenue" + " x" * 90 + " $5", None),
    ("revenue", None, None),
])
def test_figures(spark, metric, text, expected):
    assert figures(spark, text, metric) == expected


def test_period(spark):
    cases = [
        ("Q3 2024 Results", "H1 2023", "Q3 2024"),
        ("Results", "for the second quarter 2024 and Q1 2023", "Q1 2023"),
        ("Results", "for the second quarter 2024", "Q2 2024"),
        (None, "full-year 2024 report", "FULL-YEAR 2024"),
        ("FY2025", "", "FY 2025"),
        ("", "h1 2025", "H1 2025"),
        (None, "x" * 1000 + " Q1 2024", None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, title string, text string, expected string")
    assert [(r.period, r.expected) for r in with_period(rows).orderBy("i").collect()] == [(c[2], c[2]) for c in cases]


def guidance_by_hand(text, limit=2):
    """The same rule, position by position."""
    out = []
    for m in re.finditer(GUIDANCE.removeprefix("(?i)"), text, re.I):
        left, right = text.rfind(".", 0, m.start()), text.find(".", m.end())
        snippet = text[left + 1:right + 1 if right >= 0 else m.end() + GUIDANCE_TAIL]
        snippet = re.sub(r"\s+", " ", snippet).strip()
        if snippet and snippet not in out:
            out.append(snippet)
    return out[:limit]


WORDS = st.sampled_from(["guidance", "outlook", "raised", "lowers", "the board", "reaffirm", ". ", "No change. ", "x" * 210, "3.5", "  "])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=14).map(" ".join), min_size=40, max_size=40))
def test_guidance_matches_brute_force(spark, texts):
    assert column(spark, texts, guidance_sentences) == [guidance_by_hand(t) for t in texts]

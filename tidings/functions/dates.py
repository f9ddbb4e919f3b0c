"""Dates as landed text, read as UTC instants. Unreadable text gives null.

Each format is guarded by the shape of the text, so rows of another shape do
not pay for a failing parse.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import squash, strip

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# Zone names of feed dates and their offsets.
ZONE_OFFSETS = {
    "Z": "+0000", "UT": "+0000", "UTC": "+0000", "GMT": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def instant(as_of: str | dt.datetime | Column) -> Column:
    """The clock of a run as a column; text and naive values are UTC."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def cutoff(as_of, days: int) -> Column:
    """``as_of`` minus a number of days, time of day included (DT3)."""
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def _read(c: Column, shape: str, fmt: str) -> Column:
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)))


def filing_date(c: Column) -> Column:
    """``2001-08-01`` to midnight UTC."""
    return _read(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")


def listed_date(c: Column) -> Column:
    """The five formats of news lists (DT1); ISO times need an offset."""
    c = strip(c)
    spaced = F.regexp_replace(c, r"\s+", " ")
    day = r"(?i)^\d{1,2} " + _MONTH + r" \d{4}"
    iso = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}"
    return F.coalesce(
        _read(spaced, day + r" \d{1,2}:\d{1,2}$", "d MMM yyyy H:m"),
        _read(spaced, day + "$", "d MMM yyyy"),
        _read(c, iso + r"(?:Z|[+-]\d{2}:\d{2})$", "yyyy-M-d'T'H:m:sXXX"),
        _read(c, iso + r"[+-]\d{4}$", "yyyy-M-d'T'H:m:sxx"),
        filing_date(c),
    )


def date_text(c: Column) -> Column:
    """Free text made ready for :func:`free_date`: spaces squashed, no commas, short month names."""
    c = F.regexp_replace(squash(c), ",", "")
    return F.regexp_replace(c, r"(?i)\b(" + _MONTH[3:-1] + r")[a-z]*\.?(?![a-z])", "$1")


def free_date(c: Column) -> Column:
    """A date inside free text (DT2): the first shape below that occurs, else what its tokens say.

    ``c`` is a column or lambda variable that holds :func:`date_text`, kept
    apart because it is looked at once per shape. Weekdays and other words are
    passed over, text without a zone is UTC, and nothing is filled in from
    today.
    """
    iso = r"\b\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)? ?(?:Z|[+-]\d{2}:?\d{2})?"
    clock = r"(?: (\d{1,2}:\d{2})(?::(\d{2}))?)?"
    zone = r"(?: ([+-]\d{4}|" + "|".join(sorted(ZONE_OFFSETS, key=len, reverse=True)) + r")\b)?"
    day_first = r"(?i)\b(\d{1,2} " + _MONTH + r" \d{4})\b" + clock + zone
    month_first = r"(?i)\b(" + _MONTH + r" \d{1,2} \d{4})\b" + clock + r"(?: ?([ap]m)\b)?"
    slashed = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
    year_first = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"

    iso_text = F.regexp_replace(
        F.regexp_replace(F.regexp_extract(c, iso, 0), r"(\d) (\d)", "$1T$2"), " ", "")
    offsets = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])
    zone_text = F.upper(F.regexp_extract(c, day_first, 4))
    day_text = F.concat(
        F.regexp_extract(c, day_first, 1), F.lit(" "),
        _or(F.regexp_extract(c, day_first, 2), "0:00"), F.lit(":"),
        _or(F.regexp_extract(c, day_first, 3), "00"), F.lit(" "),
        F.coalesce(F.try_element_at(offsets, zone_text), F.when(zone_text.rlike(r"^[+-]"), zone_text), F.lit("+0000")),
    )
    half = F.upper(F.regexp_extract(c, month_first, 4))
    month_text = F.concat(
        F.regexp_extract(c, month_first, 1), F.lit(" "),
        _or(F.regexp_extract(c, month_first, 2), "0:00"), F.lit(":"),
        _or(F.regexp_extract(c, month_first, 3), "00"), F.when(half != "", F.concat(F.lit(" "), half)).otherwise(""),
    )
    slash_text = F.regexp_extract(c, slashed, 0)
    return (
        F.when(c.rlike(iso), F.try_to_timestamp(iso_text, F.lit("yyyy-M-d'T'H:mm[:ss[.SSSSSS]][XXX][xx]")))
        .when(c.rlike(day_first), F.try_to_timestamp(day_text, F.lit("d MMM yyyy H:mm:ss xx")))
        .when(c.rlike(month_first), F.when(half != "", F.try_to_timestamp(month_text, F.lit("MMM d yyyy h:mm:ss a")))
              .otherwise(F.try_to_timestamp(month_text, F.lit("MMM d yyyy H:mm:ss"))))
        .when(c.rlike(year_first), F.try_to_timestamp(
            F.regexp_replace(F.regexp_extract(c, year_first, 0), "/", "-"), F.lit("yyyy-M-d")))
        .when(c.rlike(slashed), F.coalesce(
            F.try_to_timestamp(slash_text, F.lit("M/d/yyyy")), F.try_to_timestamp(slash_text, F.lit("d/M/yyyy"))))
        .otherwise(token_date(c))
    )


def token_date(c: Column) -> Column:
    """A date from the tokens of a text, in whatever order they stand (DT2).

    Day (``1``, ``1st``), month by name and year in four digits have to be there;
    the first of each counts. A time (``10:30``, ``10:30:15 pm``, ``7 am``) and a zone
    (an offset, or a listed name) may be: without them it is midnight, and UTC. ``c``
    holds :func:`date_text`; nothing is filled in from today.
    """
    apart, alone = r"(?i)(?<![\w:./+-])", r"(?![\w:/]|\.\d)"
    month = F.regexp_extract(c, apart + "(" + _MONTH + ")" + r"(?![a-z])", 1)
    year = F.regexp_extract(c, apart + r"((?:19|20)\d{2})" + alone, 1)
    day = F.regexp_extract(c, apart + r"(\d{1,2})(?:st|nd|rd|th)?" + alone + r"(?! ?[ap]\.?m\b)", 1)
    clock = apart + r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?: ?([ap])\.?m\b)?"
    bare = apart + r"(\d{1,2}) ?([ap])\.?m\b"
    hour = _or(F.regexp_extract(c, clock, 1), F.regexp_extract(c, bare, 1))
    half = F.lower(_or(F.regexp_extract(c, clock, 4), F.regexp_extract(c, bare, 2)))
    number = _or(hour, "0").cast("int")
    # Hours of half a day are 1 to 12; any other is no time.
    of_day = F.when(half == "", number).when(number.between(1, 12), number % 12 + F.when(half == "p", 12).otherwise(0))
    offset = F.regexp_replace(F.regexp_extract(c, r"(?i)(?:\d|m| |utc|gmt)([+-]\d{2}:?\d{2})(?!\d)", 1), ":", "")
    name = F.upper(F.regexp_extract(c, r"(?i)(?<![a-z])(" + "|".join(sorted(ZONE_OFFSETS, key=len, reverse=True)) + r")(?![a-z])", 1))
    names = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])
    zone = F.coalesce(F.nullif(offset, F.lit("")), F.try_element_at(names, name), F.lit("+0000"))
    text = F.concat_ws(" ", year, month, day, F.concat(
        of_day.cast("string"), F.lit(":"), _or(F.regexp_extract(c, clock, 2), "00"), F.lit(":"), _or(F.regexp_extract(c, clock, 3), "00")), zone)
    there = (year != "") & (month != "") & (day != "") & of_day.isNotNull()
    return F.when(there, F.try_to_timestamp(text, F.lit("yyyy MMM d H:mm:ss xx")))


def _or(c: Column, default: str | Column) -> Column:
    return F.when(c == "", default).otherwise(c)

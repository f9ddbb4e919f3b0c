"""Reporting period and guidance sentences in announcement text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import (
    GUIDANCE, GUIDANCE_TAIL, GUIDANCE_WORDS, MAX_GUIDANCE, ORDINAL_QUARTERS, PERIOD_HEAD, PERIODS,
)
from tidings.functions.text import TO_END, first_match, squash


# Any of the periods; matches of different kinds cannot overlap.
_ANY_PERIOD = "(?i)(?:" + "|".join(p.removeprefix("(?i)") for p in PERIODS) + ")"


def with_period(df: DataFrame, title: str = "title", text: str = "text", name: str = "period", head: int = PERIOD_HEAD) -> DataFrame:
    """Add ``Q3 2024``, ``H1 2024`` or ``FULL-YEAR 2024``: title first, then the top of the text (TX7, LM5).

    The top is the first ``head`` characters.

    Each blob is searched once for periods of any kind; which kind takes
    precedence is settled on the short list of what was found.
    """
    def mentions(blob):
        found = F.array_join(F.regexp_extract_all(blob, F.lit(_ANY_PERIOD), F.lit(0)), "\n")
        return F.when(blob.contains("20"), found).otherwise("")

    listed = df.select(
        "*", mentions(F.col(title)).alias("_title_periods"),
        mentions(F.substring(text, 1, head)).alias("_text_periods"))
    found = F.coalesce(*[
        F.when(F.col(blob) != "", first_match(F.col(blob), pattern))
        for blob in ("_title_periods", "_text_periods") for pattern in PERIODS])
    shown = F.regexp_replace(F.upper(found), r"\s*(20\d{2})$", " $1")
    for word, quarter in ORDINAL_QUARTERS.items():
        shown = F.regexp_replace(shown, rf"^{word.upper()}\s+QUARTER\b", quarter)
    return listed.select(*df.columns, shown.alias(name))


def guidance_sentences(text: Column, limit: int = MAX_GUIDANCE) -> Column:
    """First distinct sentences around guidance wording (TX8).

    Matches are widened to the left to after the previous full stop and to the
    right to the next one, so neighbouring snippets may overlap. A fold over the
    matches keeps where each was found and the distinct snippets so far; once
    there are ``limit`` of them, the matches left are passed over. Each position
    and each stretch of text is bound to a variable, so it is computed once.
    """
    matches = F.regexp_extract_all(text, F.lit(GUIDANCE), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))

    def snippet(match, at):
        left = F.substring_index(F.substring(text, F.lit(1), at - 1), ".", -1)
        rest = F.substring(text, at + F.length(match), F.lit(TO_END))
        return _bound(rest, lambda after: squash(F.concat(left, match, F.when(
            after.contains("."), F.concat(F.substring_index(after, ".", 1), F.lit("."))).otherwise(F.substring(after, 1, GUIDANCE_TAIL)))))

    def collected(state, found, match, at):
        known = (found == "") | F.array_contains(state["out"], found)
        out = F.when(known, state["out"]).otherwise(F.concat(state["out"], F.array(found)))
        return F.struct((at + F.length(match)).alias("next"), out.alias("out"))

    def widen(state, match):
        at = F.call_function("locate", match, text, state["next"])
        taken = _bound(at, lambda at: _bound(snippet(match, at), lambda found: collected(state, found, match, at)))
        return F.when(F.size(state["out"]) >= limit, state).otherwise(taken)

    lowered = F.lower(text)
    may = reduce(or_, [lowered.contains(word) for word in GUIDANCE_WORDS])
    return F.when(may, F.aggregate(matches, start, widen, lambda state: state["out"])).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

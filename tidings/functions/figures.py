"""Headline figures in announcement text: amounts and year-on-year change.

A *hit* runs from a metric's label to its amount. Its position is searched once
over the whole text; amount and neighbourhood are then taken from there.
Texts that do not hold a metric's words skip its patterns altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import (
    CURRENCY, METRICS, NUMBER, UNIT, YOY_PHRASE, YOY_REACH, YOY_VERB,
)
from tidings.functions.text import TO_END, squash

FIGURE = "struct<current:string,yoy:string>"

# A bare number that is not a year: grouped, decimal, or digits outside 19xx/20xx.
_NOT_A_YEAR = (
    r"-\d+(?:,\d{3})*(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+"
    r"|\d{1,3}|\d{5,}|[03-9]\d{3}|1[0-8]\d{2}|2[1-9]\d{2}"
)
# What may follow it: an optional mark, then space and no percent sign.
_NUMBER_END = r"(?:[.,;)]?(?:\s+[^\s%]|$))"


def marked_pattern(metric: str) -> str:
    """Label, gap, amount with a currency sign or a unit. Groups: hit, amount."""
    _, label, gap = METRICS[metric]
    amount = (
        rf"{CURRENCY}\s*{NUMBER}" if metric == "eps"
        else rf"{CURRENCY}\s*{NUMBER}(?:\s*{UNIT})?|{NUMBER}\s*{UNIT}"
    )
    return rf"(?i)({label}[^\n\r]{{0,{gap}}}?({amount}))"


def bare_pattern(metric: str) -> str:
    """Label, gap, number without sign or unit. Groups: hit, number."""
    _, label, gap = METRICS[metric]
    return rf"(?i)({label}[^\n\r]{{0,{gap}}}?\s({_NOT_A_YEAR})){_NUMBER_END}"


def _has_words(text: Column, metric: str) -> Column:
    lowered = F.lower(text)
    if metric == "net_income":
        return lowered.contains("net") & (lowered.contains("income") | lowered.contains("loss"))
    return lowered.contains(metric)


def with_figures(df: DataFrame, text: str = "text", metrics=tuple(METRICS)) -> DataFrame:
    """Add one ``struct<current, yoy>`` per metric, null where nothing is found (TX5, TX6).

    Narrow: no shuffle, every expression built in. The steps are separate
    projections, so that each search over the text runs once: first where a hit
    starts, then what it says, then what stands near it.
    """
    keep = [F.col(c) for c in df.columns]
    body = F.col(text)

    def named(part, metric):
        return F.col(f"_{part}_{metric}")

    def step(rows, *parts):
        """Next projection: the parts named last are added per metric."""
        return rows.select("*", *[make(m).alias(f"_{part}_{m}") for m in metrics for part, make in parts])

    def marked_at(m):
        return F.when(_has_words(body, m), F.regexp_instr(body, F.lit(marked_pattern(m))))

    def bare_at(m):
        return F.when(named("marked", m) == 0, F.regexp_instr(body, F.lit(bare_pattern(m))))

    def start(m):
        return F.greatest(named("marked", m), named("bare", m))

    def hit(m):
        from_label = F.substring(body, start(m), F.lit(TO_END))
        return (
            F.when(named("marked", m) > 0, F.regexp_extract(from_label, marked_pattern(m), 1))
            .when(named("bare", m) > 0, F.regexp_extract(from_label, bare_pattern(m), 1))
        )

    def current(m):
        return squash(
            F.when(named("marked", m) > 0, F.regexp_extract(named("hit", m), marked_pattern(m), 2))
            .when(named("bare", m) > 0, F.regexp_extract(named("hit", m), bare_pattern(m), 2)))

    def near(m):
        first = F.greatest(F.lit(1), start(m) - YOY_REACH)
        reach = start(m) + F.length(named("hit", m)) + YOY_REACH - first
        return F.when(named("hit", m).isNotNull(), F.substring(body, first, reach))

    rows = step(df, ("marked", marked_at))
    rows = step(rows, ("bare", bare_at))
    rows = step(rows, ("hit", hit))
    rows = step(rows, ("current", current), ("near", near))
    rows = step(rows, ("phrase", lambda m: _phrase_in(named("near", m))))
    rows = step(rows, ("verb", lambda m: _verb_in(named("near", m), named("phrase", m))))
    return rows.select(*keep, *[
        F.when(named("hit", m).isNotNull(), F.struct(
            named("current", m).alias("current"),
            year_on_year(named("phrase", m), named("verb", m)).alias("yoy"),
        )).alias(m)
        for m in metrics
    ])


def _phrase_in(near: Column) -> Column:
    """A stated comparison with the year before, from its wording to the figure; empty if none."""
    lowered = F.lower(near)
    may = near.contains("%") & (lowered.contains("yoy") | lowered.contains("year"))
    return F.when(may, F.regexp_extract(near, YOY_PHRASE, 0)).otherwise("")


def _verb_in(near: Column, phrase: Column) -> Column:
    """Without such a comparison: a verb of change and its percentage; empty if none."""
    return F.when((phrase == "") & near.contains("%"), F.regexp_extract(near, YOY_VERB, 0)).otherwise("")


def year_on_year(phrase: Column, verb: Column) -> Column:
    """``up 12.2%`` or ``12.2%`` (TX6)."""
    return squash(F.when(phrase != "", F.regexp_replace(phrase, YOY_PHRASE, "$1 $2")).when(verb != "", verb))

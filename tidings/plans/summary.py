"""Documents to summary payloads and rendered alerts.

Everything here is one narrow stage of built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.fixed_values import (
    BLANK_HEADLINE, MAX_GUIDANCE, MAX_HIGHLIGHTS, METRICS, NO_FIGURES_NOTE, PERIOD_HEAD, SECTIONS, SUBJECT_PREFIX,
)
from tidings.functions.figures import with_figures
from tidings.functions.narrative import guidance_sentences, with_period
from tidings.functions.text import blank_to_null, strip
from tidings.operators.pages import headline


def _shown(metric: str) -> Column:
    """``current (yoy)`` of a metric; null where it has neither."""
    current, yoy = F.col(metric)["current"], F.col(metric)["yoy"]
    return (
        F.when(current.isNotNull(), F.concat_ws(" ", current, F.concat(F.lit("("), yoy, F.lit(")"))))
        .when(yoy.isNotNull(), F.concat(F.lit("("), yoy, F.lit(")")))
    )


def payloads(documents: DataFrame, max_highlights: int = MAX_HIGHLIGHTS, max_guidance: int = MAX_GUIDANCE,
             period_head: int = PERIOD_HEAD) -> DataFrame:
    """Documents (``url, final_url, title, title_html, text``) to payloads.

    ``max_guidance`` sentences are taken up, of which with the figures
    ``max_highlights`` are shown; periods are looked for in the first ``period_head``
    characters. A document without text, such as a PDF, has its headline only.

    Covers TX9, TX10, PJ4, PJ5, AG4, AG5, AG8, LM2, LM3. Columns of the input
    other than the texts are kept.
    """
    keep = [c for c in documents.columns if c not in ("text", "title_html", "title", "final_url")]
    base = documents.select(
        *keep, "final_url", "title", "text",
        headline(F.col("title"), F.col("title_html"), F.col("url")).alias("headline"),
        guidance_sentences(F.col("text"), max_guidance).alias("_guidance"),
    )
    read = with_figures(with_period(base, name="_period", head=period_head).drop("title")).drop("text")
    labels = {m: label for m, (label, _, _) in METRICS.items()}
    shown = read.select("*", *[_shown(m).alias(f"_{m}") for m in METRICS])
    nothing = F.coalesce(*[F.col(f"_{m}") for m in METRICS]).isNull()
    parts = F.concat_ws(
        " ",
        F.concat(F.col("_period"), F.lit(" results:")),
        *[F.concat(F.lit(labels[m] + " "), F.col(f"_{m}")) for m in METRICS],
    )
    bullets = F.array(*[F.concat(F.lit(labels[m] + ": "), F.col(f"_{m}")) for m in METRICS])
    # Distinct, in order of first occurrence, and without the missing ones.
    highlights = F.array_except(F.concat(bullets, "_guidance"), F.array(F.lit(None).cast("string")))
    return shown.select(
        *keep, "headline", "final_url",
        F.when(nothing & F.col("_period").isNull(), F.col("headline")).otherwise(parts).alias("short_summary"),
        F.slice(highlights, 1, max_highlights).alias("key_highlights"),
        *METRICS,
        F.when(nothing, F.lit(NO_FIGURES_NOTE)).alias("final_thoughts"),
    )


def subject(prefix: str = SUBJECT_PREFIX) -> Column:
    """Subject line (TX11)."""
    return F.concat(F.lit(prefix + " "), F.coalesce(blank_to_null(strip(F.col("headline"))), F.lit(BLANK_HEADLINE)))


def metric_lines() -> Column:
    """``Label: current (yoy)`` per metric found, listed (TX12); empty if none."""
    return F.concat_ws("\n - ", *[F.concat(F.lit(label + ": "), _shown(m)) for m, (label, _, _) in METRICS.items()])


def alerts(payload: DataFrame, prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """Payloads with ``subject`` and plain-text ``body`` (TX11, TX13).

    Sections without content are left out of the body.
    """
    bullets = F.filter(F.transform("key_highlights", strip), lambda b: b != "")
    listed = payload.select(
        "*",
        *[strip(F.col(c)).alias(f"_{c}") for c in ("headline", "final_url", "short_summary", "final_thoughts")],
        F.array_join(bullets, "\n - ").alias("_bullets"),
        metric_lines().alias("_metrics"),
    )

    def part(before, name):
        return F.when(F.col(name) != "", F.concat(F.lit(before), F.col(name)))

    body = F.concat(F.concat_ws(
        "\n",
        *[part(before, name) for name, before in SECTIONS.items()],
    ), F.lit("\n"))
    return listed.select(*payload.columns, subject(prefix).alias("subject"), body.alias("body"))

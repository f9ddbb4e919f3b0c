"""Text columns: spacing, blanks, entities, lists."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Length argument of a substring that runs to the end.
TO_END = 2_147_483_647

# Entities decoded inside the JVM; "&amp;" last, so that "&amp;lt;" stays "&lt;".
PLAIN_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
)
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|amp);)[#a-zA-Z]"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern or of its group, null if none; the search runs once (LM4).

    Comparing an extract with the empty text would put the search into the plan
    twice.
    """
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def squash(c: Column) -> Column:
    """Whitespace runs, Unicode ones included, to one space; ends trimmed (TX3)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends and keep the inside."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """HTML entities to characters (TX4).

    Texts with only the common entities never leave the JVM: the Python side
    is handed a null for them.
    """
    plain = c
    for entity, character in PLAIN_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    rare = c.rlike(_OTHER_ENTITY)
    return F.when(rare, _unescape(F.when(rare, c))).otherwise(plain)


def comma_list(c: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty entries (TX16)."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")

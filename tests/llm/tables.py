"""Small tables with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["score", "fp", "key_a", "key_b", "row", "size", "queue", "copies", "ids", "restored", "replaced", "first", "place", "tail", "count"]


def awkward(spark, clashing=True):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma,", "delta.", "éa", "omega", "the", "of"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = text(40_000)
    rows = [
        (1, text(60), "en", "a", 1), (2, None, "en", "a", 2), (3, "", None, "b", 3), (4, " \t\n ", "de", "b", None),
        (5, long, "en", "c", 5), (6, long + " end", "en", "c", 6), (7, "one", "en", None, 7), (8, "one", "en", "b", 8), (8, "one", "en", "b", 8),
        (None, text(30), "en", "a", 9), (None, "one", None, None, None), (9, text(60), "en", "a", 9), (9, text(61), "en", "a", 9),
        (10, "中文 字符 😀 \u0000 x", "zh", "d", 1), (11, "A" * 5_000, "en", "d", 1), (12, "!!! ??? ###", "en", "d", 1),
        *((20 + i, text(50 + i % 3), "en", f"s{i % 4}", i) for i in range(40)),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING if clashing else []:
        frame = frame.withColumn(name, frame["n_chars"])
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)

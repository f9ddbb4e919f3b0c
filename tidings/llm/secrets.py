"""Secrets in texts: spans by pattern, and random strings told apart by two Markov chains; DataFrame functions only.

Three patterns give base spans: a value assigned to a word such as ``password``, an
access key, a run of hex digits. Further candidates are runs of ``LEAST`` and more
letters, digits and ``+/_.=-`` that hold letters and touch no base span. One chain of
characters is learnt from random strings, one from ordinary identifiers, both
with added counts; a run is a secret if the logarithm of the ratio of its
likelihoods is at least ``RATIO``. Labelled samples are the corpus's own: values of
base spans against all other runs, each different one once.

Patterns give the pieces between matches, so a span's place is a running sum of
lengths over the text's spans. A model is one number for each pair of characters
(at most 128 x 128), whatever it was learnt from.

Defined results: a null text is empty; places count code points, ends are exclusive;
matches of a kind do not overlap, and such as are too short are dropped after
the search. Rows are treated one by one, also those of equal or null id. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.store import written

VALUE = "[A-Za-z0-9+/_.=-]"
#: Characters of a candidate, and the least logarithm of the likelihoods' ratio of a secret (one run in 150 is one).
LEAST, RATIO = 16, 5.0
#: Added to every count of a pair of characters.
ADDED = 0.5
#: Symbols that stand for the ends of a value; no value holds them.
START, END = "\x01", "\x02"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Kinds in their order, each with the group and the least length that it needs.
KINDS = ["assign", "access", "hex", "markov"]
NAMES = [_either_case(w) for w in ("password", "passwd", "secret", "token")] + [f"{_either_case('api')}_?{_either_case('key')}"]
PATTERNS = [
    (f"""(?:{'|'.join(NAMES)})["']?\\x20*[:=]\\x20*["']?({VALUE}+)""", 1, 6),
    ("(AKIA[A-Z0-9]+)", 1, 20),
    ("([0-9a-f]{24,})", 1, 24),
    (f"([A-Za-z0-9]{VALUE}{{{LEAST - 2},}}[A-Za-z0-9=])", 1, LEAST),
]
MARKOV = len(KINDS) - 1


def _matches(kind: int) -> Column:
    """All matches of a kind in ``text``, with the length of the text between each and the one before."""
    pattern, group, least = PATTERNS[kind]
    pattern = F.lit(pattern)
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"),
                         F.regexp_extract_all("text", pattern, F.lit(group)).alias("value"))
    # There is one gap more than matches.
    return F.transform(F.filter(parts, lambda p: p["match"].isNotNull()), lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), F.length(p["gap"]).cast("long").alias("gap"), F.length(p["match"]).cast("long").alias("size"),
        p["value"].alias("value"), (F.length(p["value"]) >= least).alias("long_enough")))


def found(documents: DataFrame) -> DataFrame:
    """``row, doc_id`` and the ``matches`` of every kind, too short ones included."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*map(_matches, range(len(KINDS)))).alias("matches"))


def located(rows: DataFrame) -> DataFrame:
    """``row, kind, start, end, value`` of every base span and every candidate that touches none."""
    matches = rows.select("row", F.explode("matches").alias("match")).select("row", "match.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0).cast("long"))
    spans = matches.withColumn("start", start).where("long_enough").withColumn("end", F.col("start") + F.col("size"))
    base = F.col("kind") < MARKOV
    order = Window.partitionBy("row").orderBy("start", "kind")
    until = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(until, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    lettered = F.col("value").rlike("[A-Za-z]")
    return spans.withColumn("free", free).where(base | (F.col("free") & lettered)).select("row", "kind", "start", "end", "value")


def samples(spans: DataFrame) -> DataFrame:
    """Labelled samples ``value, secret``: values of base spans, and candidates that never are one."""
    return spans.groupBy("value").agg(F.min(F.col("kind")).alias("kind")).select("value", (F.col("kind") < MARKOV).alias("secret"))


def _pairs(value: Column) -> tuple[Column, Column]:
    """All characters with a mark in front, and all with a mark behind."""
    characters = F.split(value, "")
    return F.concat(F.array(F.lit(START)), characters), F.concat(characters, F.array(F.lit(END)))


def train(labelled: DataFrame) -> list[float]:
    """Logarithm of the ratio of both chains' probabilities for every pair of character codes
    (128 times the first, plus the second), from ``value, secret``."""
    first, second = _pairs(F.col("value"))
    pairs = labelled.select("secret", F.explode(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("pair"))
    # At most twice the square of the characters that values are made of.
    counts = pairs.groupBy("secret", F.ascii("pair.a").alias("a"), F.ascii("pair.b").alias("b")).agg(F.count("*").alias("n")).collect()
    seen = {(r["secret"], r["a"], r["b"]): r["n"] for r in counts}
    symbols = [c for c in map(chr, range(128)) if c.isalnum() or c in "+/_.=-"]
    ratios = [0.0] * 128 * 128
    for a in [START, *symbols]:
        following = [*symbols, END]
        total = {s: sum(seen.get((s, ord(a), ord(b)), 0) for b in following) + ADDED * len(following) for s in (True, False)}
        for b in following:
            secret, ordinary = ((seen.get((s, ord(a), ord(b)), 0) + ADDED) / total[s] for s in (True, False))
            ratios[128 * ord(a) + ord(b)] = math.log(secret / ordinary)
    return ratios


def ratio(value: Column, model: list[float]) -> Column:
    """Logarithm of the likelihoods' ratio of a value."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    first, second = _pairs(value)
    steps = F.zip_with(first, second, lambda a, b: F.get(table, F.ascii(a) * 128 + F.ascii(b)))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` of every row.

    ``labelled`` (``value, secret``) trains the chains in place of the corpus's own samples.
    """
    rows = written(found(documents), "matches")
    spans = written(located(rows), "spans")
    model = train(samples(spans) if labelled is None else labelled)
    secrets = spans.where((F.col("kind") < MARKOV) | (ratio(F.col("value"), model) >= RATIO))
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per_row = secrets.groupBy("row").agg(spans.alias("all"))
    all_spans = F.coalesce("all", F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    number = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("all", all_spans).select(
        "doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_listed(F.filter("all", lambda s: s["kind"] < MARKOV)), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))

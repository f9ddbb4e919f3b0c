"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Documents of a source queue in a fixed shuffle, all of them once and then all of
them a second time. The virtual finish time of a queued copy is the words of
its source up to and including it, divided by the source's target: every source
reaches its target at time one. Copies of all sources are put in order of finish
time, and the mix ends where the words reach the total budget.

Running totals are taken in two steps, since one source may hold most rows: words
per slice of the order, a running total over slices, and a running total inside
each slice. There are as many slices as rows in a slice, the square root of all,
so both windows stay small whatever the source.

Defined results: a null text has size 0; sizes are words, runs of characters
outside ``\\x20\\x09-\\x0D``. A null source is a source, the last. Documents of size
0 are never taken. Rows that are equal in id and size are interchangeable. An
empty table gives an empty mix. Only id, text and source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.store import row_key, written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def queue(source: Column) -> Column:
    """Sources as keys that are never null and sort by code point, the null source last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def shares(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """``queue, source_size, source_rows, target`` of every source of ``sized`` (``queue``, ``size``).

    The budget is a multiple of all sizes, shared by weight; a target ends at
    ``most`` times its source's size, and what is above is shared again. That is
    one level for all: with sources in order of size per weight, those are cut off
    whose limit lies below what is left, divided by the weights that are left.
    """
    totals = sized.groupBy("queue").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy("queue")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights)).cast("int") + 1).cast("long")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "queue")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut_off = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) * most
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - cut_off
    ranked = totals.withColumn("weight", weight).withColumn(
        "level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn(
        "limit", (F.col("source_size") * most).cast("double"))
    free = F.col("level") * F.col("weight") < F.col("limit")
    # The first source that is not cut off sets the level for all after it.
    settled = F.min(F.when(free, F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "queue", "level"))).over(every)
    return ranked.withColumn("settled", settled["level"]).select(
        "queue", "source_size", "source_rows",
        F.when(free, F.least(F.col("settled") * F.col("weight"), F.col("limit"))).otherwise(F.col("limit")).alias("target"))


def running(rows: DataFrame, keys: list[str], part: str, order: list[str], size: str) -> DataFrame:
    """``before``: the sum of ``size`` over all rows of the keys that come earlier.

    Rows are in order of ``part``, and inside a part of ``order``; no key is null.
    """
    sums = rows.groupBy(*keys, part).agg(F.sum(size).alias("part_sum"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, part, F.coalesce(F.sum("part_sum").over(earlier), F.lit(0).cast("long")).alias("offset"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0).cast("long"))).join(
        offsets, [*keys, part]).withColumn("before", F.col("offset") + F.col("inside")).drop("offset", "inside")


def _turn(copy: Column) -> Column:
    """A copy's place in the order of all copies."""
    finish = ((copy - 1) * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    return F.struct(finish.alias("finish"), "queue", "place", F.coalesce("doc_id", F.lit(-2**63)).alias("id"), "size", copy.alias("copy"))


def mix(documents: DataFrame, *carried: Column, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5,
        most: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` and the carried columns for every row of ``documents``.

    ``copies`` of a document come before the end of the budget, 0 to ``most``;
    ``taken`` is their words.
    """
    place = F.md5(F.concat_ws("-", F.lit(seed), F.col("doc_id").cast("string")))
    sized = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), queue(F.col("source")).alias("queue"), words(F.col("text")).alias("size"), place.alias("place"), *carried), "sized")
    per_source = written(shares(sized, weights, budget, most), "targets")
    total, rows = per_source.agg(F.sum("source_size"), F.sum("source_rows")).first()

    point = F.conv(F.substring("place", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    queued = sized.join(per_source, "queue").withColumn("part", F.floor(point * F.ceil(F.sqrt("source_rows"))))
    queued = written(running(queued, ["queue"], "part", ["place", "doc_id", "size"], "size").drop("part"), "queued")

    # Every source yields its target in one unit of time, so parts of time are even.
    copies = queued.where("size > 0").withColumn("turn", F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), _turn)))
    copies = copies.select(F.col("size").alias("words"), "turn", F.floor(F.col("turn.finish") * math.ceil(math.sqrt(rows or 0))).alias("part"))
    over = running(copies, [], "part", ["turn"], "words").where(F.col("before") + F.col("words") > F.lit(float(total or 0) * budget))
    end = over.agg(F.min("turn").alias("turn")).first()["turn"]

    def comes_first(copy: int) -> Column:
        if end is None:
            return F.col("size") > 0
        stop = F.struct(*(F.lit(v).cast(t).alias(n) for (n, v), t in zip(end.asDict().items(), ("double", "string", "string", "long", "long", "int"))))
        return (F.col("size") > 0) & (_turn(F.lit(copy)) < stop)

    taken = sum((comes_first(copy).cast("int") for copy in range(1, most + 1)), F.lit(0))
    others = [c for c in queued.columns if c not in ("queue", "source_rows", "place", "before")]
    return queued.select(*others, taken.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    taken = mix(documents, *row_key(documents), **how).groupBy("key_a", "key_b").agg(F.sum("copies").alias("copies")).where("copies > 0")
    # Whole rows as one column, so that no name of theirs can clash. Rows equal in
    # all columns share a key; the first stands for all their copies.
    keyed = documents.select(*row_key(documents), F.struct("*").alias("row"))
    keyed = keyed.join(taken, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    return keyed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

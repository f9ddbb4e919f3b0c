"""Joins and choices that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a task may meet, keys that are dealt out, and tasks a key is dealt to.
HOT_ROWS, HOT_KEYS, MOST_SALTS = 100_000, 256, 256


def hot_key_join(many: DataFrame, few: DataFrame, keys: list[str], how: str, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``many`` rows to ``few`` narrow ones, with hot keys dealt out over several tasks.

    Rows are counted per key, and the heaviest keys beyond ``hot_rows`` get a salt
    for each ``hot_rows`` rows, taken from the columns ``by`` that differ within a
    key, so a task that is run again deals the same. Only these keys are repeated
    on the other side. They are at most ``HOT_KEYS``, which bounds what is broadcast
    to mark them, and at most ``HOT_KEYS * MOST_SALTS`` rows are added, so the
    planner's size of ``few`` stays true and a small one is broadcast as it is.
    All other keys join plainly. Null keys match nothing.
    """
    counts = many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    salts = F.least(F.ceil(F.col("_n") / hot_rows), F.lit(MOST_SALTS)).cast("int")
    hot = F.broadcast(counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys, salts.alias("_salts")))
    dealt = many.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    repeated = few.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key (WN1, AG1, AG2).

    ``row_number() = 1`` is planned as a group limit on both sides of the
    shuffle: every task passes on at most one row per key, so a key that holds
    a third of the rows costs one row per task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(spec)).filter("_nth = 1").drop("_nth")

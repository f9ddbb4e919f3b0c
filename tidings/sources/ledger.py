"""The ledger of addresses already handled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.functions.text import strip


def ledger_keys(document: Column) -> Column:
    """A ledger document to an array of keys: array, ``{"seen": [..]}`` or lines (SC11).

    Text that is not UTF-8, or starts like JSON and is none of these shapes,
    gives no keys.
    """
    raw = strip(document)
    array = F.when(raw.rlike(r"(?s)^\[.*\]$"), F.from_json(raw, "array<string>"))
    wrapped = F.when(raw.rlike(r"(?s)^\{.*\}$"), F.from_json(raw, "struct<seen:array<string>>")["seen"])
    lines = F.when(~raw.rlike(r"^[\[{}]"), F.filter(
        F.split(raw, r"\R|[\x1c-\x1e]"), lambda x: strip(x) != ""))
    keys = F.coalesce(array, wrapped, lines)
    return F.when(F.is_valid_utf8(document), F.filter(keys, lambda k: k.isNotNull()))


def ledger(documents: DataFrame, value: str = "value") -> DataFrame:
    """Distinct keys of ledger documents as ``url`` (SC11, AG7)."""
    return documents.select(F.explode(ledger_keys(F.col(value))).alias("url")).distinct()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files in any of the landed formats, one document per file (SC11)."""
    return ledger(spark.read.text(path, wholetext=True))


def read_ledger_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of files that hold JSON arrays of strings, however large (SC11).

    A file is cut into byte ranges and these at every quotation mark, which needs no
    parser that starts at its head. Whether a piece stands inside a string follows
    from the marks before it: these are counted per range, then over ranges, of which
    there are few, so a string that reaches from one range into the next is settled
    between neighbours. An escaped mark (after an odd number of backslashes) ends
    nothing; the pieces of such a string are put together again. What is no string
    is passed over, and so is a string that is not closed or not valid JSON.
    """
    pieces = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")
    marks = (F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 0).cast("int")
    inside = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.withColumn("mark", marks).withColumn("earlier", F.coalesce(F.sum("mark").over(inside), F.lit(0)))
    ranges = counted.groupBy("file", "start").agg(F.sum("mark").alias("marks"), F.max("at").alias("last"))
    of_file = Window.partitionBy("file").orderBy("start")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    # No mark follows the last piece of a file.
    last = F.when(F.lead("start").over(of_file).isNull(), F.col("last"))
    offsets = ranges.select("file", "start", F.coalesce(F.sum("marks").over(before), F.lit(0)).alias("before"), last.alias("last"))
    strings = counted.join(offsets, ["file", "start"]).withColumn("number", F.col("before") + F.col("earlier")).where("number % 2 = 1").withColumn(
        "mark", F.when(F.col("at") == F.col("last"), 0).otherwise(F.col("mark")))
    # Nearly every string is one piece; only those with escaped marks are more.
    whole = strings.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value", "mark"))).alias("parts"))
    closed = whole.where(F.element_at("parts", -1)["mark"] == 1)
    text = F.concat(F.lit('["'), F.array_join(F.transform("parts", lambda p: p["value"]), '"'), F.lit('"]'))
    return closed.select(F.get(F.from_json(text, "array<string>"), F.lit(0)).alias("url")).where("url IS NOT NULL").distinct()


def merged(*ledgers: DataFrame) -> DataFrame:
    """Union of ledgers, each key once (ST5)."""
    first, *rest = [one.select("url") for one in ledgers]
    for one in rest:
        first = first.unionByName(one)
    return first.distinct()


def save_ledger(ledgers: DataFrame, path: str) -> None:
    """Distinct keys to parquet; a committed write replaces the old one (SK1)."""
    ledgers.select("url").distinct().write.mode("overwrite").parquet(path)


def export_ledger(ledgers: DataFrame, path: str) -> None:
    """Distinct keys as JSON lines, sorted (JS2, LM6). Sorting is a range shuffle, not one task."""
    ledgers.select("url").distinct().orderBy("url").write.mode("overwrite").json(path)

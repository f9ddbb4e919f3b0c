"""Near-duplicates by SimHash, joined over a grid of segment popcounts.

Each fingerprint is mapped to the bit counts of its 2-bit segments. Moving one
bit changes one count by one, so the Manhattan distance between two such points
is at most the Hamming distance of the fingerprints: a lower bound. The points'
grid has cells of width one. Points at distance three or less are within one in
the lower or in the upper half of the coordinates (two in each would make
four), so each half is a grid of its own in which a point is compared with its
cell and with those one step up; the step down is the other point's step up.
Pairs of the grid join pass the Manhattan bound over all coordinates and then
the exact Hamming test, both inside the join condition.

Equal fingerprints are one class before any pair is made, so copies never
multiply. Classes of different fingerprints that link are all paired, whatever
their number: no cell is capped, and a full cell is a partition of a sort-merge
join that adaptive execution may split.

Defined results: a null text counts as empty; no words give fingerprint zero,
linked like any other. Repeated rows share class and component. Rows without a
``doc_id`` are compared like others; a component is named by its smallest id,
and has a null name only if none of its rows has an id. Columns besides the id
and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.components import components
from tidings.llm.store import row_key, written

SEED = 42
#: Lowest bit of every 2-bit segment.
LOW_BITS = 0x5555555555555555


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits, each the majority of that bit over all shingles' hashes."""
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return hashed(join(words), SEED)
    hashes = np.array([hashed(join(run), SEED) for run in zip(*(words[i:] for i in range(shingle)))], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """The documents' other columns and ``fp``, the fingerprint as a signed long."""
    others = [c for c in documents.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((t or "").encode().lower().split(), shingle) for t in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found.view(np.int64))], [*others, "fp"])

    return documents.select(*others, text).mapInArrow(run, documents.select(*others).schema.add("fp", "long"))


def counts(fp: Column) -> Column:
    """Bit counts of all 2-bit segments, packed into two bits each."""
    up, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(up).bitwiseAND(low))


def unary(fp: Column) -> Column:
    """The same counts in unary digits (00, 01, 11), so that differing bits add up to the Manhattan distance."""
    up, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(up).bitwiseAND(low))


def _cells(points: DataFrame, steps: bool) -> DataFrame:
    """A row for each half of the coordinates, and with ``steps`` for each cell one step up."""
    half = F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("counts").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("counts", 32).alias("cell"))))
    rows = points.withColumn("counts", counts(F.col("fp"))).select("fp", half.alias("at")).select("fp", "at.half", "at.cell")
    if not steps:
        return rows
    ups = [F.when(F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(2)) == 0, F.col("cell") + (1 << 2 * i)) for i in range(16)]
    return rows.select("fp", "half", F.col("cell").alias("own"), F.explode(F.array_compact(F.array(F.col("cell"), *ups))).alias("cell"))


def links(points: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b``: different fingerprints ``fp`` of ``points`` that differ in 1 to ``bits`` bits; ``bits`` is 3 at most.

    A pair may come once for each half.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the two half grids cover distances up to 3")
    left = _cells(points, steps=True).withColumnRenamed("fp", "a").alias("l")
    right = _cells(points, steps=False).withColumnRenamed("fp", "b").alias("r")
    a, b = F.col("l.a"), F.col("r.b")
    near = (
        (F.col("l.half") == F.col("r.half")) & (F.col("l.cell") == F.col("r.cell"))
        & ((F.col("l.own") != F.col("l.cell")) | (a < b))
        & (F.bit_count(unary(a).bitwiseXOR(unary(b))) <= bits)
        & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    )
    return left.join(right, near).select("a", "b")


def classes(marked: DataFrame, bits: int, first: Column) -> DataFrame:
    """``fp, first``: for every fingerprint of ``marked`` the least ``first`` of its component."""
    own = written(marked.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    linked = written(components(links(own, bits)).withColumnRenamed("node", "fp"), "components")
    joined = own.join(linked, "fp")
    named = joined.groupBy("root").agg(F.min("first").alias("least"))
    least = linked.join(named, "root").select("fp", "least")
    return own.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(documents: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    marked = written(fingerprints(documents.select("doc_id", "text"), shingle), "marked")
    # As a table, both sides of the join below come straight from a shuffle, and
    # a fingerprint that many documents share can be split at run time.
    named = written(classes(marked, bits, F.col("doc_id")), "classes")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def first_of_group(documents: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Rows with an id come before rows without; ties go to the smaller row key, so
    of rows equal in all columns one stays.
    """
    marked = written(fingerprints(documents.select(*row_key(documents), "doc_id", "text"), shingle), "marked")
    order = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "key_a", "key_b")
    stay = classes(marked, bits, order).select("first.key_a", "first.key_b").distinct()
    # Whole rows as one column, so that no name of theirs can clash.
    keyed = documents.select(*row_key(documents), F.struct("*").alias("row"))
    return keyed.join(stay, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select("row.*")

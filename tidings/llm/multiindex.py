"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set where it is above zero. Codes
are cut into segments, and each segment has an index from its value to the
codes that have it. A query looks up its own value in every segment, then values
one bit away, then two, and so on; after radius ``r`` in the first ``s`` of ``m``
segments, every code at distance ``m * r + s - 1`` or less has been met. Codes met
are verified by their full Hamming distance, and a query is done once its kth
distance is covered in that way: nothing unseen can be nearer. Equal distances
go to the smaller id.

Equal codes are one entry with its k smallest ids, which are all that a top-k can
need. Entries are dealt to shards by hash; blocks of queries search each
shard's index exactly, and the shards' answers are merged by a second top-k.

Defined results: a null or empty vector, one with null or NaN components, and a
null id have no code; such rows are neither queries nor answers. Only
codes of the query's length are compared. Repeated rows are answers of
their own. Fewer than k rows give fewer answers. Only the id and the vector are
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.store import written


def code(vector: Column) -> Column:
    """Bytes of '0' and '1', a character for each component; null where there is no code."""
    value = vector.cast("array<double>")
    bits = F.array_join(F.transform(value, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.when((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x)), bits)


def matrix(codes: pa.Array) -> np.ndarray:
    """The codes as rows of 0 and 1."""
    text = "".join(codes.to_pylist()).encode()
    return (np.frombuffer(text, np.uint8) - ord("0")).reshape(len(codes), -1)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words, filled up with zeros."""
    filled = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    filled[:, :bits.shape[1]] = bits
    return np.packbits(filled, axis=1).view(">u8").astype(np.uint64)


class Index:
    """Segment tables over a shard's codes."""

    def __init__(self, bits: np.ndarray, segment: int):
        self.words = words(bits)
        self.cuts = np.linspace(0, bits.shape[1], max(1, round(bits.shape[1] / segment)) + 1).astype(int)
        self.tables = []
        for value, width in self._segments(bits):
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1))))

    def _segments(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        for low, high in itertools.pairwise(self.cuts):
            yield bits[:, low:high].astype(np.int64) @ (1 << np.arange(high - low)), int(high - low)

    def nearest(self, bits: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every query its place, and distances and ids of the k nearest answers.

        ``ids`` has a row of up to k ids, ascending, for each code; -1 fills up.
        """
        query = words(bits)
        values = list(self._segments(bits))
        count, parts = len(self.words), len(values)
        for q in range(len(bits)):
            met = np.zeros(count, bool)
            best_d, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for radius in range(max(width for _, width in values) + 1):
                covered = False
                for s, ((value, width), (order, starts)) in enumerate(zip(values, self.tables)):
                    if radius <= width:
                        probes = value[q] ^ flips(width, radius)
                        lows, highs = starts[probes], starts[probes + 1]
                        some = highs > lows
                        spans = [order[a:b] for a, b in zip(lows[some], highs[some])]
                        fresh = np.concatenate(spans) if spans else order[:0]
                        fresh = fresh[~met[fresh]]
                        if len(fresh):
                            met[fresh] = True
                            distance = np.bitwise_count(self.words[fresh] ^ query[q]).sum(axis=1, dtype=np.int64)
                            found = ids[fresh]
                            there = found >= 0
                            d = np.concatenate((best_d, np.repeat(distance, there.sum(axis=1))))
                            i = np.concatenate((best_i, found[there]))
                            first = np.lexsort((i, d))[:k]
                            best_d, best_i = d[first], i[first]
                    # All segments before this one are searched to this radius, the others to one less.
                    if len(best_d) == k and best_d[-1] <= parts * radius + s:
                        covered = True
                        break
                if covered or met.all():
                    break
            yield q, best_d, best_i


_FLIPS: dict[tuple[int, int], np.ndarray] = {}


def flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` of them set."""
    if (width, radius) not in _FLIPS:
        _FLIPS[width, radius] = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.int64)
    return _FLIPS[width, radius]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, segment: int = 12, shard_rows: int = 200_000, least_shards: int = 8,
            block_rows: int = 4_096) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` nearest rows of ``vectors`` to each row for which ``queries`` is true.

    A row is not an answer to itself. ``segment`` bits, about the logarithm of a
    shard's codes, make a segment.
    """
    # A query meets itself, so one more is looked for.
    most = k + 1
    coded = written(vectors.select("vec_id", code(F.col("embedding")).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks"))
                    .where("vec_id is not null and code is not null"), "codes")
    ranked = Window.partitionBy("code").orderBy("vec_id")
    entries = written(
        coded.select("code", "vec_id", F.row_number().over(ranked).alias("n")).where(F.col("n") <= most)
        .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = coded.where("asks").select(F.col("vec_id").alias("query_id"), "code").distinct()
    lengths = entries.groupBy(F.length("code").alias("length")).count().collect()
    shards = max([least_shards, *(-(-row["count"] // shard_rows) for row in lengths)])
    blocks = max(1, -(-asked.count() // block_rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index, ids = None, [], None, None
        for batch in batches:
            keys = np.char.add(np.char.add(batch.column("shard").to_numpy().astype(str), "-"), batch.column("place").to_numpy().astype(str))
            for here in dict.fromkeys(keys.tolist()):
                part = batch.filter(pa.array(keys == here))
                if here != place:
                    place, held, index = here, [], None
                is_entry = np.array(part.column("query_id").is_null())
                if is_entry.any():
                    held.append(part.filter(pa.array(is_entry)).select(["code", "ids"]))
                asks = part.filter(pa.array(~is_entry))
                if not len(asks) or not held:
                    continue
                if index is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    lists = table.column("ids").to_pylist()
                    ids = np.array([row + [-1] * (most - len(row)) for row in lists], np.int64)
                    index = Index(matrix(table.column("code").chunk(0)), segment)
                names = asks.column("query_id").to_pylist()
                found = [(names[q], d, i) for q, d, i in index.nearest(matrix(asks.column("code")), ids, most)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                     pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32))],
                    ["query_id", "vec_id", "distance"])

    def keyed(rows: DataFrame, shard: Column, block: Column) -> DataFrame:
        # Codes of one length, one shard and one block meet in a place.
        return rows.withColumn("shard", shard).withColumn("place", F.length("code") * F.lit(blocks) + block)

    none = F.lit(None)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    kept = keyed(entries.withColumn("block", every_block), F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"), F.col("block")).select(
        "shard", "place", none.cast("long").alias("query_id"), "code", "ids")
    sent = keyed(asked, every_shard, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select(
        "shard", "place", "query_id", "code", none.cast("array<long>").alias("ids"))
    answers = kept.union(sent).repartition("shard", "place").sortWithinPartitions("shard", "place", F.col("query_id").asc_nulls_first()).mapInArrow(
        search, "query_id long, vec_id long, distance int")
    # A query is its own answer once; where its id is repeated, the other rows stay.
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    itself = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("vec_id") != F.col("query_id")).cast("int"), "distance"))
    others = answers.withColumn("self", (itself == 1) & (F.col("vec_id") == F.col("query_id"))).where("not self")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

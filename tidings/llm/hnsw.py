"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class and enter once. Classes are dealt to shards by hash;
each shard is built into a graph of layers. All classes, in blocks, query the
graph of every shard, which a task reads from the written table once for all its blocks. Small
upper layers are looked through whole, the lowest is walked by beams. From vectors inside the
threshold a search goes on along all links between such vectors, in both
directions, so no number of neighbours is too large. The first
queries of every block, by a hash of their vectors, are an audit: their neighbours are also found by brute
force in the shard, and beams are widened for the block until the audit's recall
is reached, in small groups as in large ones, at the last to the whole shard. What a beam finds is verified by
cosine in double precision. A task joins what it has linked into trees, so it
passes on as many rows as it has vectors, not as it has pairs; the components of
all trees are found by Spark.

Defined results: vectors that are null, empty or zero, hold null or non-finite
components, or have a null id, link with nothing; vectors link with those of their
own length only. Every row is a vector of its own: repeated
rows link with each other. Only the id and the vector are read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.components import components
from tidings.llm.store import written
from tidings.session import spread, work_folder

#: Neighbours of a vector in upper layers; twice as many in the lowest.
DEGREE = 16
#: Beam of insertions, and vectors inserted together.
BUILD_BEAM, INSERTED = 80, 256
#: Of the ten nearest, however far, an audit wants this part found.
NEAREST = 0.75
#: Candidates from which a vector's neighbours are chosen; their bits fit in 64.
CONSIDERED = 64
#: Queries searched together, and bytes of their marks of visited vectors at most.
TOGETHER, MARKS = 256, 64 << 20
#: An upper layer of at most so many vectors is looked through whole, and its nearest are so many ways into the next.
LISTED, ENTRIES = 16_384, 16
#: Vectors of a beam whose neighbours are looked at together.
OPENED = 1
#: The part of a packed vector that is its number.
NUMBER = (1 << 31) - 1
#: Cosines in single precision are off by less.
MARGIN = 1e-4


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _single(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision, some at a time."""
    out = np.empty(rows.shape, np.float32)
    for low in range(0, len(rows), 8_192):
        out[low:low + 8_192] = _unit_rows(rows[low:low + 8_192])
    return out


def _packed(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Cosine and number in one integer that is larger for a larger cosine; the lowest bit is free, 0 is nothing."""
    return (near + np.float32(2)).view(np.int32).astype(np.int64) << 32 | ids.astype(np.int64) << 1


class Graph:
    """A graph over vectors, searched and built for many queries at once."""

    def __init__(self, vectors: np.ndarray):
        """``vectors`` has rows of floats, none of them zero, in an order that says nothing about them."""
        self.exact = vectors
        self.vectors = _single(vectors)
        count = len(vectors)
        chance = np.random.default_rng(count).random(count)
        level = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(DEGREE)).astype(int), 8)
        level[:1] = level.max(initial=0)
        # Layer by layer: rows of neighbours, -1 where there is none yet.
        self.layers = [np.full((count, DEGREE * (2 if l == 0 else 1)), -1, np.int32) for l in range(level.max(initial=0) + 1)]
        self.upper = [np.flatnonzero(level >= l) for l in range(1, len(self.layers))]
        size = 1
        while size < count:
            added = np.arange(size, min(count, size + min(INSERTED, size)))
            self._insert(added, level, size)
            size += len(added)
        # Who leads to a vector: from place ends[v - 1] up to ends[v].
        lowest = self.layers[0].ravel()
        order = np.argsort(lowest, kind="stable")[np.count_nonzero(lowest < 0):]
        self.leading, self.ends = (order // self.layers[0].shape[1]).astype(np.int32), np.cumsum(np.bincount(lowest[order], minlength=count))

    def _insert(self, added: np.ndarray, level: np.ndarray, size: int) -> None:
        beams = self.descend(self.vectors[added], BUILD_BEAM, size, len(self.layers) - 1, level[added])
        together = self.vectors[added] @ self.vectors[added].T
        for layer, (found, near) in beams.items():
            mine = np.flatnonzero(level[added] >= layer)
            peers = np.where((level[added] >= layer)[None, :] & (np.arange(len(added))[None, :] != mine[:, None]), together[mine], -np.inf)
            keep = min(peers.shape[1], BUILD_BEAM // 2)
            best = np.argpartition(-peers, keep - 1, axis=1)[:, :keep]
            ids = np.concatenate((found, np.where(np.isfinite(np.take_along_axis(peers, best, 1)), added[best], -1)), axis=1)
            self._link(layer, added[mine], ids, np.concatenate((near, np.take_along_axis(peers, best, 1)), axis=1))

    def _link(self, layer: int, nodes: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        table = self.layers[layer]
        table[nodes] = self._chosen(ids, near, table.shape[1])
        # Back links: the new neighbours of every old one, then its choice anew.
        source = np.repeat(nodes, table.shape[1])
        target = table[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        old, first, many = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(old), TOGETHER):
            o, f, m = old[low:low + TOGETHER], first[low:low + TOGETHER], many[low:low + TOGETHER]
            wide = np.full((len(o), m.max(initial=0)), -1, np.int32)
            rows = np.repeat(np.arange(len(o)), m)
            wide[rows, np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)] = source[f[0]:f[0] + len(rows)]
            ids = np.concatenate((table[o], wide), axis=1)
            near = np.matmul(self.vectors.take(ids, axis=0), self.vectors.take(o, axis=0)[:, :, None])[:, :, 0]
            near[ids < 0] = -np.inf
            # A link that is there already counts once.
            sort = np.argsort(ids, axis=1, kind="stable")
            again = np.zeros_like(ids, bool)
            np.put_along_axis(again, sort[:, 1:], np.diff(np.take_along_axis(ids, sort, 1), axis=1) == 0, 1)
            near[again] = -np.inf
            table[o] = self._chosen(np.where(again, -1, ids), near, table.shape[1])

    def _chosen(self, ids: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
        """Of candidates in any order, up to ``degree`` that lie in different directions, then the nearest others."""
        order = np.argsort(-near, axis=1, kind="stable")[:, :CONSIDERED]
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        there = np.isfinite(near) & (ids >= 0)
        rows = self.vectors.take(ids, axis=0)
        # Bit j of the k-th number: candidate j is nearer to candidate k than k is to the vector.
        bits = np.zeros((*ids.shape, 8), np.uint8)
        shadows = np.packbits(rows @ rows.transpose(0, 2, 1) > near[:, :, None], axis=2, bitorder="little")
        bits[:, :, :shadows.shape[2]] = shadows
        bits = bits.view("<u8")[:, :, 0]
        apart, taken = np.zeros_like(there), np.zeros(len(ids), np.uint64)
        for k in range(ids.shape[1]):
            apart[:, k] = there[:, k] & (bits[:, k] & taken == 0)
            taken |= apart[:, k].astype(np.uint64) << np.uint64(k)
        rank = np.argsort(np.where(apart, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :degree]
        out = np.full((len(ids), degree), -1, np.int32)
        out[:, :rank.shape[1]] = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return out

    def beam(self, queries: np.ndarray, entry: np.ndarray, width: int, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` vectors nearest to each query that a walk over a layer meets, nearest first, and their cosines."""
        count, table = len(queries), self.layers[layer]
        # Rows of marks end with one for the neighbour -1, which thus is never new.
        stride = size + 1
        seen = np.zeros(count * stride, np.uint8)
        seen[size::stride] = 1
        entry = entry[:, :width]
        keys = np.zeros((count, width), np.int64)
        near = np.einsum("nkd,nd->nk", self.vectors.take(entry, axis=0), queries)
        keys[:, :entry.shape[1]] = np.where(entry >= 0, _packed(near, entry), 0)
        r, c = np.nonzero(entry >= 0)
        seen[r * stride + entry[r, c]] = 1
        # Rows still walking, and their beams; the lowest bit says that a vector's neighbours have been looked at.
        active, held, opened = np.arange(count), keys.copy(), min(OPENED, width)
        while True:
            open_ = np.where(held & 1, 0, held)
            top = np.partition(open_, width - opened, axis=1)[:, width - opened:]
            going = top.max(axis=1, initial=0) > 0
            if not going.all():
                keys[active[~going]] = held[~going]
                active, held, open_, top = active[going], held[going], open_[going], top[going]
            if not len(active):
                break
            held |= open_ >= np.maximum(top[:, :1], 1)
            next_ = table.take(top >> 1 & NUMBER, axis=0)
            next_[top == 0] = -1
            columns = next_.shape[1] * next_.shape[2]
            place = ((active * stride)[:, None] + next_.reshape(len(active), columns)).ravel()
            fresh = np.flatnonzero(seen.take(place) == 0)
            # Of several that lead to the same vector the last one's number stays.
            place, number = place.take(fresh), (fresh % columns + 1).astype(np.uint8)
            seen[place] = number
            fresh = fresh[seen.take(place) == number]
            r, v = fresh // columns, next_.ravel().take(fresh)
            new = _packed(np.einsum("nd,nd->n", self.vectors.take(v, axis=0), queries.take(active.take(r), axis=0)), v)
            better = new > held.min(axis=1)[r]
            r, new = r[better], new[better]
            if len(r):
                many = np.bincount(r, minlength=len(active))
                most = many.max()
                wide = np.zeros((len(active), width + most), np.int64)
                wide[:, :width] = held
                wide[r, width + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)] = new
                held = np.partition(wide, most, axis=1)[:, most:]
        keys = np.sort(keys, axis=1)[:, ::-1]
        near = (keys >> 32).astype(np.int32).view(np.float32) - np.float32(2)
        return np.where(keys > 0, keys >> 1 & NUMBER, -1).astype(np.int32), np.where(keys > 0, near, np.float32(-np.inf))

    def members(self, layer: int, size: int) -> int:
        """How many of the first ``size`` vectors an upper layer has."""
        return int(np.searchsorted(self.upper[layer - 1], size))

    def _nearest(self, queries: np.ndarray, width: int, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``beam``, from the whole of an upper layer."""
        ids = self.upper[layer - 1][:self.members(layer, size)]
        near = queries @ self.vectors.take(ids, axis=0).T
        best = np.argpartition(-near, min(width, len(ids)) - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        out, cosines = np.full((len(queries), width), -1, np.int32), np.full((len(queries), width), -np.inf, np.float32)
        out[:, :best.shape[1]], cosines[:, :best.shape[1]] = np.take_along_axis(ids[best], order, 1), np.take_along_axis(near, order, 1)
        return out, cosines

    def descend(self, queries: np.ndarray, width: int, size: int, top: int, level: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Beams from the top layer down; with ``level``, those of each layer for the queries that reach it, else the lowest."""
        found, entry = {}, np.zeros((len(queries), 1), np.int32)
        listed = [layer for layer in range(1, top + 1) if self.members(layer, size) <= LISTED]
        for layer in range(top, -1, -1):
            # Above the layers where a query is wanted, one nearest vector leads on.
            wide = np.ones(len(queries), bool) if layer == 0 else level >= layer if level is not None else np.zeros(len(queries), bool)
            if layer in listed:
                if layer == listed[0]:
                    ids, near = self._nearest(queries, width, layer, size)
                    entry = ids[:, :ENTRIES]
                    found[layer] = ids[wide], near[wide]
                elif wide.any():
                    found[layer] = self._nearest(queries[wide], width, layer, size)
                continue
            next_ = np.full((len(queries), width), -1, np.int32)
            for which, beam in ((wide, width), (~wide, 1)):
                if which.any():
                    ids, near = self.beam(queries[which], entry[which], beam, layer, size)
                    next_[which, :beam] = ids
                    if beam == width and which is wide:
                        found[layer] = ids, near
            entry = next_
        return found

    def _sure(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Cosines of pairs in double precision."""
        out = np.empty(len(q))
        for low in range(0, len(q), 16_384):
            part = slice(low, low + 16_384)
            out[part] = np.einsum("nd,nd->n", queries[q[part]], _unit_rows(self.exact[v[part]]))
        return out

    def _around(self, query: np.ndarray, ids: np.ndarray, least: float) -> np.ndarray:
        """The vectors inside ``least`` to which links between such vectors, followed both ways, lead from ``ids``, and ``ids``."""
        seen = np.zeros(len(self.vectors), bool)
        seen[ids] = True
        out = [ids]
        while len(out[-1]):
            next_ = self.layers[0].take(out[-1], axis=0).ravel()
            end = self.ends[out[-1]]
            many = end - np.where(out[-1] > 0, self.ends[out[-1] - 1], 0)
            back = self.leading[np.repeat(end - np.cumsum(many), many) + np.arange(many.sum())]
            next_ = np.concatenate((next_[next_ >= 0], back))
            next_ = np.unique(next_[~seen[next_]])
            seen[next_] = True
            out.append(next_[self.vectors.take(next_, axis=0) @ query >= least])
        return np.concatenate(out)

    def _steps(self, count: int, width: int) -> Iterator[slice]:
        """So many queries at a time that the marks of visited vectors stay bounded however wide the beam."""
        step = max(1, min(TOGETHER, MARKS // max(1, len(self.vectors) + 64 * width)))
        for low in range(0, count, step):
            yield slice(low, min(count, low + step))

    def links(self, queries: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of each pair found whose cosine is at least the threshold; queries are unit rows in double precision."""
        count, out = len(self.vectors), []
        for part in self._steps(len(queries), min(width, count)):
            near_by = queries[part].astype(np.float32)
            if width >= count:
                q, v = np.nonzero(near_by @ self.vectors.T >= threshold - MARGIN)
            else:
                ids, near = self.descend(near_by, width, count, len(self.layers) - 1)[0]
                inside = near >= threshold - MARGIN
                # A beam that is full inside the threshold has left out more, and others may have.
                several = np.flatnonzero(inside.sum(axis=1) > 1)
                more = [self._around(near_by[row], ids[row, inside[row]], threshold - MARGIN) for row in several]
                inside[several] = False
                q, k = np.nonzero(inside)
                q, v = np.concatenate((q, np.repeat(several, [len(x) for x in more]))), np.concatenate((ids[q, k], *more))
            q = q + part.start
            sure = self._sure(queries, q, v) >= threshold
            out.append((q[sure], v[sure]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))

    def audited_width(self, queries: np.ndarray, threshold: float, width: int, recall: float, own: np.ndarray | None = None) -> int:
        """The beam, doubled until ``recall`` of the queries' links, and NEAREST of their ten nearest, are found.

        Recall is the mean over queries that have links, and is asked of small
        groups apart from large ones: by powers of two of the number of links.
        ``own`` has the places of the queries themselves, or -1; finding oneself is
        no link. Of vectors without any link only the latter shows whether the walk gets through.
        """
        count, wanted, nearest = len(self.vectors), [], []
        few = max(1, MARKS // (16 * count))
        for low in range(0, len(queries), few):
            near = queries[low:low + few].astype(np.float32) @ self.vectors.T
            tenth = np.partition(near, count - min(10, count), axis=1)[:, count - min(10, count)]
            q, v = np.nonzero(near >= tenth[:, None])
            nearest.append((q + low) * count + v)
            q, v = np.nonzero(near >= threshold - MARGIN)
            # Sums in another order may put a pair on the other side.
            sure = self._sure(queries, q + low, v) >= threshold + 1e-9
            wanted.append((q[sure] + low) * count + v[sure])
        wanted, nearest = np.concatenate(wanted), np.concatenate(nearest)
        if own is not None:
            wanted = wanted[own[wanted // count] != wanted % count]
        many = np.bincount(wanted // count, minlength=len(queries))
        linked = np.flatnonzero(many)
        groups = np.log2(many[linked]).astype(int)
        while width < count:
            q, v = self.links(queries, threshold, width)
            code = q * count + v
            part = np.bincount(q[np.isin(code, wanted)], minlength=len(queries))[linked] / many[linked]
            met = []
            for some in self._steps(len(queries), width):
                ids, _ = self.descend(queries[some].astype(np.float32), width, count, len(self.layers) - 1)[0]
                met.append((np.arange(some.start, some.stop)[:, None] * count + ids)[ids >= 0])
            if np.isin(nearest, np.concatenate(met)).mean() >= NEAREST and all(part[groups == g].mean() >= recall for g in np.unique(groups)):
                break
            width *= 2
        return width

    def dumped(self) -> bytes:
        return dumped({"exact": self.exact, "leading": self.leading, "ends": self.ends}
                      | {f"layer{i}": layer for i, layer in enumerate(self.layers)} | {f"upper{i}": ids for i, ids in enumerate(self.upper)})

    @classmethod
    def loaded(cls, data: bytes) -> Graph:
        graph, saved = cls.__new__(cls), loaded(data)
        graph.exact, graph.leading, graph.ends = (saved.pop(name) for name in ("exact", "leading", "ends"))
        graph.layers = [saved[f"layer{i}"] for i in range((len(saved) + 1) // 2)]
        graph.upper = [saved[f"upper{i}"] for i in range(len(graph.layers) - 1)]
        graph.vectors = _single(graph.exact)
        return graph


def dumped(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays behind a line that says what they are."""
    head = json.dumps([(name, array.dtype.str, array.shape) for name, array in arrays.items()]).encode()
    return b"".join((head.ljust(-(-(len(head) + 1) // 64) * 64 - 1), b"\n", *(memoryview(np.ascontiguousarray(array)).cast("B") for array in arrays.values())))


def loaded(data: bytes) -> dict[str, np.ndarray]:
    """The arrays again, as views."""
    at, out = bytes(data[:65_536]).index(b"\n") + 1, {}
    for name, kind, shape in json.loads(bytes(data[:at])):
        many = int(np.prod(shape))
        out[name] = np.frombuffer(data, kind, many, at).reshape(shape)
        at += many * np.dtype(kind).itemsize
    return out


def _rows(column: pa.Array) -> np.ndarray:
    """Rows of numbers, from lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _trees(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what the given links join, one fewer than nodes in each tree."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x_root, y_root = root(x), root(y)
        if x_root != y_root:
            above[max(x_root, y_root)] = min(x_root, y_root)
    return ((x, root(x)) for x in list(above) if root(x) != x)


#: Bytes of a graph in one row, and of rows that the writer of graphs holds back.
PIECE, GROUP = 256 << 10, 32 << 20
#: Bytes of a shard in memory.
SHARD = 224 << 20
#: Blocks of queries that a task holds while it loads one graph after the other.
BLOCKS = 8


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, shard_rows: int = 262_144, least_shards: int = 8, block_rows: int = 8_192,
                    beam: int = 32, audit: int = 128, recall: float = 0.99) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    A shard holds about ``shard_rows`` different vectors, fewer where these would
    take more than SHARD bytes, which bounds a task's memory; small tables have ``least_shards``. ``audit`` queries of each block
    of ``block_rows`` are audited in each shard. Graphs are a table that tasks
    read by path, each graph once for all queries a task holds: neither graphs
    nor queries are copied for one another.
    """
    value = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    # Single precision stays so on its way; arithmetic with it is in double precision.
    kind = vectors.schema["embedding"].dataType
    held = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else value
    # Equal vectors have equal keys; 128 bits tell all others apart.
    keys = [F.when(usable, F.xxhash64(F.lit(seed), value)).alias(name) for seed, name in ((1, "key_a"), (2, "key_b"))]
    rows = written(vectors.select("vec_id", *keys, F.when(usable, held).alias("embedding")), "vectors")
    same = written(rows.where("embedding is not null").groupBy("key_a", "key_b").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        # Ids may name several vectors, so links are between numbers of classes.
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = same.groupBy(F.size("embedding").alias("length")).count().collect()
    names = rows.select("vec_id", "key_a", "key_b")
    if not sizes:
        return names.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    parts = [_linked(same.where(F.size("embedding") == row["length"]), row["length"], row["count"], threshold, shard_rows, least_shards, block_rows, beam, audit, recall)
             for row in sorted(sizes)]
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    found = written(found, "links")
    counts = found.where("n_links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("other_links"))
    roots = components(found.where("b is not null"))
    rooted = written(same.select("node", "key_a", "key_b", "first", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")), "rooted")
    # A table again, so that the join with all rows can split a vector that many share.
    classes = written(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        "key_a", "key_b", (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links"), "component_id"), "answers")
    # Rows without a usable vector have no key and keep their own name.
    linked = names.where("key_a is not null").join(classes, ["key_a", "key_b"]).select("vec_id", "n_links", "component_id")
    alone = names.where("key_a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _turn() -> Column:
    """An order of vectors that says nothing about their ids; the first in it are audited."""
    return F.xxhash64(F.lit(3), "key_a", "key_b")


def _linked(classes: DataFrame, length: int, count: int, threshold: float, shard_rows: int, least_shards: int, block_rows: int, beam: int, audit: int, recall: float) -> DataFrame:
    """``a, n_links`` of classes of vectors of one length, and tree links ``a, b``; one of ``n_links``, ``b`` is null."""
    # A vector is held as it came and in single precision, and its links both ways.
    size = length * (classes.schema["embedding"].dataType.elementType.jsonValue() == "float" and 8 or 12) + 16 * DEGREE + 24
    shards = max(least_shards, -(-count // max(1, min(shard_rows, SHARD // size))))
    dealt = classes.select(F.col("node").alias("first"), "copies", "embedding", _turn().alias("turn"), F.pmod("key_a", F.lit(shards)).cast("int").alias("shard"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None

        def graph() -> Iterator[pa.RecordBatch]:
            first, copies = (np.concatenate([batch.column(name).to_numpy() for batch in held]) for name in ("first", "copies"))
            vectors = np.concatenate([_rows(batch.column("embedding")) for batch in held])
            held.clear()
            for kind, content in enumerate((Graph(vectors).dumped(), dumped({"first": first, "copies": copies}))):
                for part, at in enumerate(range(0, len(content), PIECE)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([content[at:at + PIECE]], pa.binary())],
                        ["shard", "kind", "part", "content"])

        for batch in batches:
            for here in np.unique(batch.column("shard").to_numpy()):
                if here != shard and held:
                    yield from graph()
                shard = int(here)
                held.append(batch.filter(pa.array(batch.column("shard").to_numpy() == here)).select(["first", "copies", "embedding"]))
        if held:
            yield from graph()

    # A partition for each shard, so that no two meet in one task while others idle.
    path = work_folder(classes.sparkSession, "graphs")
    dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "turn", "first").mapInArrow(
        build, "shard int, kind int, part int, content binary").write.option("parquet.block.size", GROUP).partitionBy("shard").parquet(path)
    # A shard may hold no vector of this length.
    files: dict[str, list[str]] = {}
    for file in sorted(classes.sparkSession.read.parquet(path).inputFiles()):
        files.setdefault(os.path.dirname(file), []).append(file)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, all_names = (np.concatenate([part.column(name).to_numpy() for part in parts]) for name in ("turn", "first"))
            rows = np.concatenate([_rows(part.column("embedding")) for part in parts])
            parts.clear()
            order = np.lexsort((all_names, turn))
            for graph, members in map(_graph, files.values()):
                at = {name: i for i, name in enumerate(members["first"].tolist())}
                for low in range(0, len(order), block_rows):
                    block = order[low:low + block_rows]
                    queries, names = _unit_rows(rows[block]), all_names[block]
                    own = np.array([at.get(name, -1) for name in names[:audit].tolist()])
                    width = graph.audited_width(queries[:audit], threshold, beam, recall, own)
                    q, v = graph.links(queries, threshold, width)
                    other = names[q] != members["first"][v]
                    q, v = q[other], v[other]
                    counts = np.bincount(q, members["copies"][v], len(names)).astype(np.int64)
                    trees = list(_trees(names[q], members["first"][v]))
                    some = np.flatnonzero(counts)
                    a = np.concatenate((names[some], np.array([t[0] for t in trees], np.int64)))
                    b = pa.array([None] * len(some) + [t[1] for t in trees], pa.int64())
                    n = pa.array(counts[some].tolist() + [None] * len(trees), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], ["a", "b", "n_links"])

        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= BLOCKS * block_rows:
                yield from answers(waiting)
        if sum(map(len, waiting)):
            yield from answers(waiting)

    return spread(dealt.select("first", "embedding", "turn")).mapInArrow(search, "a long, b long, n_links long")


def _graph(files: list[str]) -> tuple[Graph, dict[str, np.ndarray]]:
    """Graph and members of a shard, from its files in the shared folder."""
    contents = bytearray(), bytearray()
    for file in files:
        store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))
        with store.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(64, columns=["kind", "part", "content"], use_threads=False):
                for kind, part, content in zip(*(batch.column(name).to_pylist() for name in ("kind", "part", "content"))):
                    at, held = part * PIECE, contents[kind]
                    held.extend(bytes(max(0, at + len(content) - len(held))))
                    held[at:at + len(content)] = content
    return Graph.loaded(contents[0]), loaded(contents[1])

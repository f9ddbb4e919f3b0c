"""Trie of conversations that begin alike, as balanced parentheses per shard.

Conversations become paths of turn digests (16 bytes a turn) and words; texts are
left behind. Paths are range-sorted, so those with a common beginning are
neighbours whatever task they are in, and equal paths are in order of id. A task
reads its paths in order and closes a shard after a bounded number of turns. A
shard's trie is a string of parentheses in preorder:

* blocks with the least and greatest excess find the closing parenthesis of
  every node, which delimits its subtree;
* the rank of leaf pairs ``()`` at both ends gives the leaves between;
* differences of cumulative arrays give the conversations and the savings.

Only nodes on a shard's first and last path (its spine) can occur in other
shards. All others are done. Of the spine, two paths go on to the next level
with what hangs from each node already summed; there they are paths of a
shard like any other, many shards' spines to one, until one shard is left.

Member ids of a node are hashed where they are, or, on a spine, in a stream over
the pieces that shards hold of them, in order: equal conversations without number
cost a row per 4,096 ids. Nodes that hang from a spine node learn their parent's
smallest member by a join over shards.

One conversation's digests and words are held by one task (24 bytes a turn).

Defined results: turns of equal number are in order of the MD5 of their role and
text; a null turn is the first, null role and text are empty; repeated rows are
turns of their own; rows without ``conv_id`` belong to no conversation. An empty
table has no nodes, not even a root. Only ``conv_id, turn, role, text`` are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.mixing import words
from tidings.llm.store import written

#: Turns after which a shard is closed, and the least paths that a level above the first takes in.
SHARD_TURNS, SHARD_PATHS = 1 << 16, 64
#: Ids of a node's members in one piece.
PIECE_IDS = 4_096
NOBODY = np.iinfo(np.int64).max
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
#: What hangs from each node of a path.
HANGING = ["mass", "children", "leaves", "saved", "low"]


class Parentheses:
    """A balanced string, +1 for an opening and -1 for a closing parenthesis."""

    BLOCK, AT_ONCE = 256, 8_192

    def __init__(self, steps: np.ndarray):
        self.steps, self.excess = steps, np.cumsum(steps)
        self.blocks = np.append(self.excess, np.zeros(-len(steps) % self.BLOCK, np.int64)).reshape(-1, self.BLOCK)
        self.low, self.high = self.blocks.min(1), self.blocks.max(1)
        self.opens = np.flatnonzero(steps > 0)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The first places after these whose excess is one less."""
        out = np.empty(len(opens), np.int64)
        for at in range(0, len(opens), self.AT_ONCE):
            out[at:at + self.AT_ONCE] = self._find_close(opens[at:at + self.AT_ONCE])
        return out

    def _find_close(self, opens: np.ndarray) -> np.ndarray:
        target, block = self.excess[opens, None] - 1, opens // self.BLOCK
        hit = (self.blocks[block] == target) & (np.arange(self.BLOCK) > (opens % self.BLOCK)[:, None])
        inside = hit.any(1)
        out = block * self.BLOCK + hit.argmax(1)
        # Excess changes by one at a time, so the first later block whose range holds the target has it.
        far = np.flatnonzero(~inside)
        if len(far):
            holds = (self.low <= target[far]) & (target[far] <= self.high) & (np.arange(len(self.low)) > block[far, None])
            later = holds.argmax(1)
            out[far] = later * self.BLOCK + (self.blocks[later] == target[far]).argmax(1)
        return out

    def leaf_rank(self, leaves: np.ndarray) -> np.ndarray:
        """Before each place, how many leaf pairs open; ``leaves`` tells which of the nodes count."""
        pairs = np.zeros(len(self.steps) + 1, np.int64)
        pairs[self.opens[leaves] + 1] = 1
        return np.cumsum(pairs)


class Trie:
    """The trie of a shard's paths, given in order.

    ``keys`` are the digests of each path's turns, ``words`` the words of all their
    turns in a row, ``hanging`` for every place from the root down each path what hangs there.
    """

    def __init__(self, keys: list[bytes], words: np.ndarray, hanging: dict[str, np.ndarray], complete: bool):
        self.keys, self.lengths = keys, np.array([len(k) // 16 for k in keys])
        lengths, turns = self.lengths, int(self.lengths.sum())
        digests = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        starts = np.cumsum(lengths) - lengths
        path = np.repeat(np.arange(len(keys)), lengths)
        place = np.arange(turns) - starts[path]
        before = np.maximum(path - 1, 0)
        both = np.flatnonzero((path > 0) & (place < lengths[before]))
        same = np.zeros(turns, bool)
        same[both] = (digests[both] == digests[starts[before[both]] + place[both]]).all(1)
        self.shared = lengths.copy()
        some = lengths > 0
        if turns:
            self.shared[some] = np.minimum.reduceat(np.where(same, lengths[path], place), starts[some])
        # Nodes in preorder: the root, then each path's turns beyond those shared with the path before.
        fresh = place >= self.shared[path]
        self.depth = np.append(0, place[fresh] + 1)
        self.words = np.append(0, words[fresh])
        self.created = 1 + np.cumsum(lengths - self.shared)
        self.count = n = len(self.depth)
        closing = np.append(0, lengths[:-1] - self.shared[1:])
        runs = np.concatenate(([1], np.column_stack((closing, lengths - self.shared)).ravel(), [lengths[-1] + 1]))
        signs = np.concatenate(([1], np.tile([-1, 1], len(keys)), [-1]))
        self.tree = tree = Parentheses(np.repeat(signs, runs))
        self.closes = tree.find_close(tree.opens)
        self.after = np.arange(n) + (self.closes - tree.opens + 1) // 2

        by_depth = self.depth * (n + 1) + np.arange(n)
        self._order = np.argsort(by_depth)
        self._sorted = by_depth[self._order]
        self.parent = self.on_path(self.depth - 1, np.arange(n))
        self.parent[0] = -1
        spots = np.repeat(np.arange(len(keys)), lengths + 1)
        depths = np.arange(len(spots)) - (np.cumsum(lengths + 1) - lengths - 1)[spots]
        node = self.on_path(depths, self.created[spots])
        self.spine = np.zeros(n, bool)
        if not complete:
            self.spine[node[(spots == 0) | (spots == len(keys) - 1)]] = True

        own = {name: np.zeros(n, np.int64) for name in HANGING[:-1]}
        for name, total in own.items():
            np.add.at(total, node, hanging[name])
        self.low = np.full(n, NOBODY)
        np.minimum.at(self.low, node, hanging["low"])
        self.own_low = self.low.copy()
        for depth in range(int(self.depth.max()), 0, -1):
            here = self._order[slice(*np.searchsorted(self._sorted, (depth * (n + 1), (depth + 1) * (n + 1))))]
            np.minimum.at(self.low, self.parent[here], self.low[here])
        self.own = own
        self.convs = self.below(own["mass"])
        self.children = own["children"] + np.bincount(self.parent[1:], minlength=n)
        rank = tree.leaf_rank(self.children == 0)
        self.leaves = rank[self.closes + 1] - rank[tree.opens] + self.below(own["leaves"])
        self.saved = self.below(own["saved"] + np.where(self.spine, 0, (self.convs - 1) * self.words))

    def on_path(self, depth: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The last nodes of these depths that come before these places in preorder."""
        return self._order[np.maximum(np.searchsorted(self._sorted, depth * (self.count + 1) + before) - 1, 0)]

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, the node included."""
        until = np.append(0, np.cumsum(values))
        return until[self.after] - until[:-1]

    def ends(self) -> np.ndarray:
        """The node at which each path ends."""
        return self.on_path(self.lengths, self.created)

    def spines(self) -> Iterator[tuple[bytes, dict[str, np.ndarray], np.ndarray]]:
        """Key, hanging values and nodes of the first and the last path; nodes of both have theirs on the first."""
        hangs = np.flatnonzero(~self.spine & np.append(False, self.spine[self.parent[1:]]))
        totals = {name: self.own[name].copy() for name in HANGING[:-1]} | {"low": self.own_low.copy()}
        for name, values in (("mass", self.convs), ("leaves", self.leaves), ("saved", self.saved)):
            np.add.at(totals[name], self.parent[hangs], values[hangs])
        np.add.at(totals["children"], self.parent[hangs], 1)
        np.minimum.at(totals["low"], self.parent[hangs], self.low[hangs])
        for path in sorted({0, len(self.keys) - 1}):
            nodes = self.on_path(np.arange(self.lengths[path] + 1), np.full(self.lengths[path] + 1, self.created[path]))
            yield self.keys[path], {name: values[nodes] for name, values in totals.items()}, nodes
            for values in totals.values():
                values[nodes] = 0
            totals["low"][nodes] = NOBODY


def names(key: bytes) -> list[bytes]:
    """Names of the nodes from the root down a path."""
    chain, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(key), 16):
        chain.update(key[at:at + 16])
        out.append(chain.digest())
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
SCHEMA = ("kind string, part int, shard int, side int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
          " saved_tokens long, ends_sha256 string, name binary, parent string, piece int, ids string, key binary, words array<long>, "
          + ", ".join(f"{name} array<long>" for name in HANGING))
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def _batch(kind: str, size: int, columns: dict) -> pa.RecordBatch:
    types = {"kind": pa.string(), "ends_sha256": pa.string(), "parent": pa.string(), "ids": pa.string(), "name": pa.binary(), "key": pa.binary(),
             "part": pa.int32(), "shard": pa.int32(), "side": pa.int32(), "piece": pa.int32(), "words": pa.list_(pa.int64())}
    types |= {name: pa.list_(pa.int64()) for name in HANGING}
    columns = {"kind": [kind] * size} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[f], types.get(f, pa.int64())) if f in columns else pa.nulls(size, types.get(f, pa.int64()))
                                       for f in FIELDS], FIELDS)


def _emitted(level: int, part: int, shard: int, trie: Trie, members: list[int] | None) -> Iterator[pa.RecordBatch]:
    """What is done in a shard, and what goes on to the next level."""
    done = np.flatnonzero(~trie.spine)
    # Members that end at each node, known where paths are conversations.
    at_end: dict[int, list[int]] = {}
    if members is not None:
        for node, member in zip(trie.ends().tolist(), members):
            at_end.setdefault(node, []).append(member)

    named: dict[int, bytes] = {}
    spines = list(trie.spines()) if trie.spine.any() else []
    for key, _, nodes in spines:
        named.update(zip(nodes.tolist(), names(key)))
    if members is None:
        for path, key in enumerate(trie.keys):
            fresh = slice(trie.shared[path] + 1 if path else 0, None)
            named.update(zip(trie.on_path(np.arange(len(key) // 16 + 1), np.full(len(key) // 16 + 1, trie.created[path])).tolist()[fresh], names(key)[fresh]))

    if len(done):
        above = trie.parent[done]
        root = above < 0
        hangs = ~root & trie.spine[above]
        parents = {node: f"{level}-{part}-{shard}-{node}" for node in set(above[hangs].tolist())}
        columns = {"conv_id": trie.low[done], "depth": trie.depth[done], "n_convs": trie.convs[done], "n_children": trie.children[done],
                   "n_leaves": trie.leaves[done], "saved_tokens": trie.saved[done],
                   "parent_conv_id": pa.array(trie.low[above], mask=root | hangs),
                   "parent": [parents[a] if h else None for a, h in zip(above.tolist(), hangs.tolist())]}
        if members is None:
            columns["name"] = [named[n] for n in done.tolist()]
        else:
            columns["ends_sha256"] = [hashlib.sha256(",".join(map(str, at_end[n])).encode()).hexdigest() if n in at_end else NO_MEMBERS for n in done.tolist()]
        yield _batch("node", len(done), columns)
        if parents:
            yield _batch("parent", len(parents), {"parent": list(parents.values()), "name": [named[n] for n in parents]})
    for side, (key, hanging, nodes) in enumerate(spines):
        yield _batch("spine", 1, {"part": [part], "shard": [shard], "side": [side], "key": [key], "words": [trie.words[nodes[1:]]]}
                     | {name: [values] for name, values in hanging.items()})
    for node, ids in at_end.items():
        if trie.spine[node]:
            pieces = [",".join(map(str, ids[at:at + PIECE_IDS])) for at in range(0, len(ids), PIECE_IDS)]
            yield _batch("ids", len(pieces), {"part": [part] * len(pieces), "shard": [shard] * len(pieces), "name": [named[node]] * len(pieces),
                                              "piece": list(range(len(pieces))), "ids": pieces})


def _shards(level: int, last: bool, shard_turns: int):
    """Shards of a task's sorted paths; at level 0 the paths are conversations."""
    least = SHARD_PATHS if level else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, paths = TaskContext.get().partitionId(), 0, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            keys, counts, rest = zip(*paths)
            if level:
                hanging = {name: np.concatenate([r[i] for r in rest]) for i, name in enumerate(HANGING)}
            else:
                lengths = np.array([len(k) // 16 + 1 for k in keys])
                hanging = {name: np.zeros(lengths.sum(), np.int64) for name in HANGING[:-1]} | {"low": np.full(lengths.sum(), NOBODY)}
                ends = np.cumsum(lengths) - 1
                hanging["mass"][ends], hanging["low"][ends] = 1, rest
            trie = Trie(list(keys), np.concatenate(counts), hanging, complete=last)
            return _emitted(level, part, shard, trie, None if level else list(rest))

        for batch in batches:
            key, counts = batch.column("key").to_pylist(), batch.column("words").to_numpy(zero_copy_only=False)
            if level:
                rest = zip(*(batch.column(name).to_numpy(zero_copy_only=False) for name in HANGING))
            else:
                rest = batch.column("conv_id").to_pylist()
            for path in zip(key, (np.asarray(c, np.int64) for c in counts), rest):
                paths.append(path)
                held += len(path[0]) // 16 + 1
                if not last and held >= shard_turns and len(paths) >= least:
                    yield from closed()
                    held, shard, paths = 0, shard + 1, []
        if paths:
            yield from closed()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids, whose pieces come one after another."""
    name, digest = None, None
    for batch in batches:
        done = []
        for of, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if of == name:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest = of, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["name", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "digest"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order, each with the MD5 of role and text, in hex, and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
                    digest.alias("digest"), words(text).alias("words"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_heads(conversations: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Conversations of ``turns_of`` that begin as the first of their group of ids does.

    The first ``crc32(conv_id) mod (most + 1)`` turns are those of the group's first, all
    of them if it has fewer, none if it is absent; behind them come the own turns after as many.
    """
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = conversations.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("head"))
    taken = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    return conversations.withColumn("first", first).join(heads, "first", "left").withColumn("taken", taken).select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")),
                            F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``conv_id, turns`` (see ``turns_of``), the root included:
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    digests: Column = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    paths = written(conversations.select("conv_id", F.unhex(digests).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    out = written(paths.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_shards(0, False, shard_turns), SCHEMA), "trie")
    levels = [out]
    while True:
        spines = out.where("kind = 'spine'").select("part", "shard", "side", "key", "words", *HANGING)
        count, turns = spines.agg(F.count("*"), F.sum(F.length("key") / 16 + 1)).first()
        if not count:
            break
        last = count <= SHARD_PATHS or turns <= 4 * shard_turns
        # Enough paths to a task that their number falls with every level.
        tasks = math.ceil(min(turns / (2 * shard_turns), count / (4 * SHARD_PATHS)))
        spines = spines.repartition(1) if last else spines.repartitionByRange(tasks, "part", "shard", "side")
        run = _shards(len(levels), last, shard_turns)
        out = written(spines.sortWithinPartitions("part", "shard", "side").mapInArrow(run, SCHEMA), "trie")
        levels.append(out)

    upper = functools.reduce(DataFrame.union, levels[1:] or levels)
    pieces = levels[0].where("kind = 'ids'").select("name", "part", "shard", "piece", "ids")
    digest = pieces.repartition("name").sortWithinPartitions("name", "part", "shard", "piece").mapInArrow(_hashed, "name binary, digest string")
    shared = written(upper.where("kind = 'node'").select(*NODE, "name", "parent").join(digest, "name", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.lit(NO_MEMBERS))).drop("digest"), "spine-nodes")
    parents = levels[0].union(upper).where("kind = 'parent'").select("name", "parent").join(
        shared.select("name", F.col("conv_id").alias("found")), "name").drop("name")
    nodes = levels[0].where("kind = 'node'").select(*NODE, "ends_sha256", "parent").union(shared.select(*NODE, "ends_sha256", "parent"))
    hanging = nodes.where("parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("found"))
    return nodes.where("parent IS NULL").drop("parent").union(hanging.select(*NODE, "ends_sha256"))

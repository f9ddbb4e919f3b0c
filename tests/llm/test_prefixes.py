"""The trie of conversations, against sets of members per prefix."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import tuples
from tidings.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def _expected(rows):
    """Nodes by the definition, from (conv_id, turn, role, text)."""
    original = collections.defaultdict(list)
    for c, n, role, text in rows:
        role, text = role or "", text or ""
        original[c].append(((n is not None, n or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    original = {c: [t for _, t in sorted(turns)] for c, turns in original.items() if c is not None}
    rebuilt = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(original.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for prefix, ids in members.items():
        size = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += prefix not in children
            saved[prefix[:d]] += size
    out = []
    for prefix, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(rebuilt[c]) == len(prefix))
        out.append((ids[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(ids), children[prefix], leaves[prefix], saved[prefix],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _random_rows(seed, conversations, words, longest):
    r = random.Random(seed)
    return [(c, n, r.choice(["user", "assistant", None]), " ".join(r.choices(words, k=r.randrange(3))) or None)
            for c in r.sample(range(-30, 3 * conversations), conversations) for n in range(r.randrange(1, longest))]


def _trie(spark, rows, **how):
    turns = prefixes.turns_of(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).repartition(3))
    return tuples(prefixes.prefix_trie(prefixes.with_heads(turns), **how))


@pytest.mark.parametrize("shard_turns", [1, 40, prefixes.SHARD_TURNS])
def test_trie_of_random_conversations(spark, shard_turns):
    rows = _random_rows(shard_turns, 400, ["a", "b"], 7)
    assert _trie(spark, rows, shard_turns=shard_turns) == _expected(rows)


def test_many_copies_and_one_long_conversation(spark):
    """A third are copies, one conversation has many turns, all begin alike."""
    rows = [(c, n, "user", t) for c in range(0, 6000, 20) for n, t in enumerate(("hello there", "x", "y y"))]
    rows += [(c, n, "user", f"{n} {c % 7}" if n else "hello there") for c in range(6001, 6400, 3) for n in range(4)]
    rows += [(7000, n, "user", f"turn {n}") for n in range(150)]
    assert _trie(spark, rows, shard_turns=64) == _expected(rows)


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, 1, "user", None), (None, 1, "user", "nobody's"),
            (20, 5, "", "x" * 100_000), (21, 1, "user", "中文 字符"), (22, 1, "user", "one"), (23, 1, "user", "one"), (-5, 1, "user", "two words"), (0, 0, "a", "b")]
    assert _trie(spark, rows) == _expected(rows)
    assert _trie(spark, []) == []


def test_closing_parentheses_are_found(spark):
    r = random.Random(3)
    for size in (1, 5, 300, 5000):
        steps, depth, opened = [1], 1, 1
        while depth or opened < size:
            up = opened < size and (depth <= 1 or r.random() < r.choice([0.3, 0.7, 0.95]))
            steps.append(1 if up else -1)
            depth += steps[-1]
            opened += up
            if not depth:
                break
        tree, stack, expected = prefixes.Parentheses(np.array(steps)), [], {}
        for at, step in enumerate(steps):
            if step > 0:
                stack.append(at)
            else:
                expected[stack.pop()] = at
        assert tree.find_close(tree.opens).tolist() == [expected[o] for o in tree.opens.tolist()]

"""Operators without SQL, restated in plain Python that shares nothing with them."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from tests.llm.tables import awkward
from tidings.llm import boosted, feistel

GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".:;", b",", b"!?", b"#$%&*@+=~^_", b"|/\\", b"()[]{}<>\"'"]


def _kind(byte):
    for k, group in enumerate(GROUPS):
        if byte in group:
            return k
    return 12 if byte >= 0xC0 else 13 if byte >= 0x80 else 11


def _statistics(text):
    data = (text or "").encode()
    words, lines = data.split(), [line for line in re.split(rb"[\n\r]+", data) if line]
    n, pairs = max(1, len(words)), set(zip(words, words[1:]))
    kinds = [sum(_kind(b) == k for b in data) / max(1, len(data)) for k in range(14)]
    return kinds + [
        math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)), len(set(words)) / n,
        len(pairs) / max(1, len(words) - 1), sum(len(w) <= 3 for w in words) / n, sum(_kind(w[0]) == 0 for w in words) / n,
        sum(_kind(w[-1]) in (7, 8, 9) for w in words) / n, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines))]


def test_document_statistics(spark):
    r = random.Random(3)
    texts = [row["text"] for row in awkward(spark).collect()]
    texts += ["".join(r.choices("Aab9 \t\n\r.,!#|(\x01é中", k=r.randrange(200))) for _ in range(300)]
    found = boosted.statistics(pa.array(texts))
    assert np.allclose(found, [_statistics(t) for t in texts], rtol=1e-12)


def test_one_tree_against_all_splits():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 20, size=(300, 4)).astype(float)
    labels = ((rows[:, 2] > 11) | (rng.random(300) < 0.2)).astype(float)
    rate, ridge, weight = 0.15, 1.0, 1.0
    trees = boosted.grow(rows, labels, trees=1, depth=2, rate=rate, ridge=ridge, weight=weight)
    p = labels.mean()
    slope, curve = p - labels, np.full(300, p * (1 - p))

    def best(rows_in):
        g, h = slope[rows_in].sum(), curve[rows_in].sum()
        gains = []
        for c in range(4):
            for cut in np.unique(np.quantile(rows[:, c], np.linspace(0, 1, 65)[1:-1])):
                low = rows_in & (rows[:, c] <= cut)
                a, b = slope[low].sum(), curve[low].sum()
                if b >= weight and h - b >= weight:
                    gains.append((a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge), c, cut))
        # A split that gains nothing is not made.
        return max([*gains, (0.0, 0, math.inf)])

    everything = np.ones(300, bool)
    gain, column, cut = best(everything)
    assert (trees.column[0, 0], trees.above[0, 0]) == (column, cut) and gain > 1
    for node, side in ((1, rows[:, column] <= cut), (2, rows[:, column] > cut)):
        gain, c, at = best(side)
        c0, at0 = trees.column[0, node], trees.above[0, node]
        low = side & (rows[:, c0] <= at0)
        # Equal gains may be met by several cuts.
        a, b, g, h = slope[low].sum(), curve[low].sum(), slope[side].sum(), curve[side].sum()
        assert math.isclose(a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge), gain, rel_tol=1e-9, abs_tol=1e-9)
        for leaf, members in ((2 * node - 1 - 1, low), (2 * node - 1, side & ~low)):
            assert math.isclose(trees.leaf[0, leaf], -rate * slope[members].sum() / (curve[members].sum() + ridge), rel_tol=1e-9)


def _place(number, rows, key):
    """Six rounds over two halves of a power of four, and again while beyond the rows."""
    wide = 2**64
    half = 1
    while 4**half < rows:
        half += 1

    def mixed(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % wide
        z = (z ^ z >> 27) * 0x94D049BB133111EB % wide
        return z ^ z >> 31

    while True:
        left, right = number >> half, number % 2**half
        for i in range(6):
            left, right = right, (left ^ mixed((right + key + (i + 1) * 0x9E3779B97F4A7C15) % wide)) % 2**half
        number = left * 2**half + right
        if number < rows:
            return number


def test_places_of_the_network(spark):
    for rows in (1, 2, 3, 16, 17, 64, 65, 1_000):
        expected = [_place(n, rows, 20240229) for n in range(rows)]
        assert sorted(expected) == list(range(rows))
        assert feistel.Shuffle(rows, 20240229).place(np.arange(rows)).tolist() == expected


def test_shards_and_slots(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    places = {i: _place(i, 100, 20240229) for i in range(100)}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in feistel.shard(docs).collect()} == {(i, p % 8, p // 8) for i, p in places.items()}

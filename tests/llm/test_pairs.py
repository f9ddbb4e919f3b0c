"""Near-duplicates of texts and vectors, components, and search, against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.tables import awkward, empty, tuples
from tidings.llm import hnsw, mixing, multiindex, simhash
from tidings.llm.components import components
from tidings.llm.store import row_key

VECTORS = "vec_id long, embedding array<float>, label int"


def _roots(nodes, links):
    above = {n: n for n in nodes}

    def find(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 480)] + [(500, n) for n in range(501, 560)]
    rows = [*links, (7, 7), (None, 3), *links[:5]]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert found == _roots({n for link in real for n in link}, real)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _fingerprint_roots(rows):
    prints = [_fingerprint(t) for _, t in rows]
    kinds = sorted(set(prints))
    return prints, _roots(kinds, [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1:] if (a ^ b).bit_count() <= 3])


def _expected(rows):
    prints, roots = _fingerprint_roots(rows)
    names = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            names[roots[p]] = min(doc_id, names.get(roots[p], doc_id))
    return sorted(((d, f"{p:016x}", names.get(roots[p])) for (d, _), p in zip(rows, prints)), key=repr)


def test_simhash_on_awkward_rows(spark):
    docs = awkward(spark)
    assert tuples(simhash.near_duplicates(docs)) == _expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_on_given_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert tuples(simhash.near_duplicates(docs)) == _expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_popcount_grid_finds_every_pair(spark):
    """Fingerprints at all distances from a few centres, among them full and empty segments."""
    r = random.Random(4)
    centres = [0, 2**64 - 1, r.getrandbits(64), r.getrandbits(64)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), d)) for c in centres for d in (0, 1, 2, 3, 4, 5) for _ in range(25)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    for bits in (0, 1, 3):
        found = {frozenset((x["a"], x["b"])) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
        wanted = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits}
        assert found == wanted
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_manhattan_distance_is_a_lower_bound(spark):
    r = random.Random(5)
    pairs = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(500)]
    frame = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", F.bit_count(simhash.unary(F.col("a")).bitwiseXOR(simhash.unary(F.col("b")))).alias("d"))
    for row in frame.collect():
        counts = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
        assert row["d"] == sum(abs(x - y) for x, y in zip(counts(row["a"]), counts(row["b"]))) <= (row["a"] ^ row["b"]).bit_count()


def test_one_of_each_group_stays_whole(spark):
    docs = awkward(spark)
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    _, roots = _fingerprint_roots([(r["doc_id"], r["text"]) for r in rows])
    # Two texts share the id 9; each of their groups keeps a row.
    assert kept.count() == len(set(roots.values()))
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}
    assert simhash.first_of_group(empty(spark)).count() == 0


def test_rows_that_differ_in_nulls_or_nested_columns_have_keys_of_their_own(spark):
    rows = spark.createDataFrame(
        [(1, "t", "en", None, {"a": 1}, [None, "x"]), (1, "t", None, "en", {"a": 1}, [None, "x"]), (1, "t", None, "en", {"a": 2}, [None, "x"]),
         (1, "t", None, "en", {"a": 2}, ["x", None]), (1, "t", None, "en", None, None), (1, "t", None, "en", {"a": 2}, ["x", None])],
        "doc_id long, text string, lang string, source string, m map<string,int>, l array<string>")
    assert rows.select(*row_key(rows)).distinct().count() == 5
    assert simhash.first_of_group(rows).count() == 1
    mixed = mixing.mixed(rows).collect()
    given = collections.Counter(map(repr, rows.collect()))
    assert mixed and all(n <= 2 * given[row] for row, n in collections.Counter(map(repr, mixed)).items())


def _vectors(spark, seed=3, repeated=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    near = base[:30, None] + rng.normal(scale=0.06, size=(30, 6, 16))
    rows = [*base, *near.reshape(-1, 16), *([base[0]] * 60), *(base[:5] * 3)]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, None),
             (n + 5, [float("inf")] + [1.0] * 15, 1), (None, rows[0][1], 1), (5, rows[5][1], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [1e-30] * 16, 0)]
    if repeated:
        # Ids that name several vectors.
        rows += [(7, rows[40][1], 1), (2, rows[130][1], 1), (3, rows[2][1], 1)]
    return spark.createDataFrame(rows, VECTORS).withColumn("first", F.lit(1)).withColumn("code", F.lit("x"))


def _linked(rows, threshold):
    def unit(row):
        v = row["embedding"]
        if row["vec_id"] is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r) for r in rows]
    pairs = [(i, j) for i, a in enumerate(units) for j, b in enumerate(units)
             if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold]
    roots = _roots(range(len(rows)), [(a, b) for a, b in pairs if a < b])
    names = {}
    for i, r in enumerate(rows):
        if r["vec_id"] is not None:
            names[roots[i]] = min(names.get(roots[i], r["vec_id"]), r["vec_id"])
    links = np.bincount([a for a, _ in pairs], minlength=len(rows))
    return sorted(((r["vec_id"], int(links[i]), names.get(roots[i]) if r["vec_id"] is not None else None, r["vec_id"] is not None and r["vec_id"] == names.get(roots[i]))
                   for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shape", [{}, {"least_shards": 3, "block_rows": 40, "beam": 4}])
def test_vector_links_and_components(spark, shape):
    vectors = _vectors(spark, repeated=True)
    assert tuples(hnsw.near_duplicates(vectors, 0.95, **shape)) == _linked(vectors.collect(), 0.95)


def test_graphs_and_queries_are_not_copied_for_one_another(spark, monkeypatch):
    plans, write = {}, hnsw.written

    def kept(frame, purpose):
        plans[purpose] = frame._jdf.queryExecution().executedPlan().toString()
        return write(frame, purpose)

    monkeypatch.setattr(hnsw, "written", kept)
    hnsw.near_duplicates(_vectors(spark), 0.95, block_rows=10)
    # Neither rows of graphs for each block nor queries for each shard.
    assert "MapInArrow" in plans["links"] and "Generate" not in plans["links"]


def test_links_are_followed_both_ways():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1, 24)) + rng.normal(scale=0.05, size=(600, 24))
    graph = hnsw.Graph(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    graph = hnsw.Graph.loaded(bytearray(graph.dumped()))
    # Nothing leads to these any more, but they lead to others.
    graph.layers[0][np.isin(graph.layers[0], np.arange(500, 520))] = -1
    wanted = graph.exact[:100] @ graph.exact.T >= 0.95
    q, v = graph.links(graph.exact[:100], 0.95, 32)
    assert wanted[:, 500:520].any() and len(q) == wanted.sum() and wanted[q, v].all()


def test_vectors_that_cannot_link(spark):
    rows = [(1, None, 0), (2, [0.0], 0), (None, [1.0], 0)]
    assert tuples(hnsw.near_duplicates(spark.createDataFrame(rows, VECTORS))) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)], key=repr)
    assert hnsw.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_recall_and_wide_beams():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(1, 24))
    cluster = centre + rng.normal(scale=0.03, size=(700, 24))
    rows = np.concatenate((cluster, rng.normal(size=(1_500, 24))))[rng.permutation(2_200)]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    graph = hnsw.Graph.loaded(hnsw.Graph(rows).dumped())
    wanted = rows @ rows.T >= 0.95
    width = graph.audited_width(rows[:100], 0.95, 8, 0.99)
    q, v = graph.links(rows, 0.95, width)
    assert len(set(zip(q.tolist(), v.tolist()))) == len(q) and wanted[q, v].all()
    assert len(q) >= 0.99 * wanted.sum()


@pytest.mark.parametrize("shape", [{}, {"least_shards": 3, "block_rows": 3, "segment": 5}])
def test_nearest_codes(spark, shape):
    vectors = _vectors(spark)
    found = multiindex.nearest(vectors, F.col("vec_id") % 7 == 0, k=6, **shape)
    rows = [(r["vec_id"], tuple(x > 0 for x in r["embedding"])) for r in vectors.collect()
            if r["vec_id"] is not None and r["embedding"] and not any(x is None or np.isnan(x) for x in r["embedding"])]
    wanted = []
    for q, code in {(i, c) for i, c in rows if i % 7 == 0}:
        others = list(rows)
        others.remove((q, code))
        near = sorted((sum(a != b for a, b in zip(code, c)), i) for i, c in others if len(c) == len(code))[:6]
        wanted += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert tuples(found) == sorted(wanted, key=repr)
    assert multiindex.nearest(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_audit_asks_small_groups_apart_from_large_ones():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(101, 24))
    rows = np.concatenate((centres[0] + rng.normal(scale=0.05, size=(300, 24)), np.repeat(centres[1:], 3, axis=0) + rng.normal(scale=0.05, size=(300, 24))))
    graph = hnsw.Graph(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    queries = np.concatenate((np.arange(120), np.arange(300, 324)))
    assert graph.audited_width(graph.exact[queries], 0.95, 32, 0.99, queries) < 600
    # No link leads to any of the small groups that are audited.
    for layer in graph.layers:
        layer[(layer >= 300) & (layer < 324)] = -1
    assert graph.audited_width(graph.exact[queries], 0.95, 32, 0.99, queries) >= 600


def test_audited_vectors_lie_all_over_the_ids(spark):
    rows = spark.range(4_000).select("id", F.xxhash64(F.lit(1), "id").alias("key_a"), F.xxhash64(F.lit(2), "id").alias("key_b"))
    audited = [r["id"] for r in rows.withColumn("turn", hnsw._turn()).orderBy("turn").limit(128).collect()]
    assert all(sum(a // 500 == part for a in audited) > 4 for part in range(8))

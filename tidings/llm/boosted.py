"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of whole texts are computed in Arrow batches; trees are grown with
numpy from histograms of binned columns on a bounded sample of labelled rows, and
flattened into arrays (one complete binary tree per row), which all tasks
traverse at once for all documents of a batch.

Defined results: a null text counts as empty; every text has a score, empty ones
too. Repeated rows are scored alike. Labels with a null document or a null
label are not learnt from, and of repeated labels the larger counts. Without
any label nothing is known against a text: its score is 1. Only ``doc_id`` and
``text`` are read, so further columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm import lexical

#: Bytes by kind: upper case, lower case, digits, spaces, line ends, sentence
#: ends, commas, emphasis, symbols, bars, brackets and quotes, other ASCII,
#: lead bytes of longer characters, their further bytes.
KINDS = 14
KIND = np.full(256, 11, np.uint8)
KIND[ord("A"):ord("Z") + 1] = 0
KIND[ord("a"):ord("z") + 1] = 1
KIND[ord("0"):ord("9") + 1] = 2
KIND[[0x20, 0x09]] = 3
KIND[[0x0A, 0x0D]] = 4
KIND[[ord("."), ord(":"), ord(";")]] = 5
KIND[ord(",")] = 6
KIND[[ord("!"), ord("?")]] = 7
KIND[np.frombuffer(b"#$%&*@+=~^_", np.uint8)] = 8
KIND[np.frombuffer(b"|/\\", np.uint8)] = 9
KIND[np.frombuffer(b"()[]{}<>\"'", np.uint8)] = 10
KIND[0xC0:] = 12
KIND[0x80:0xC0] = 13

STATISTICS = KINDS + 11


def _distinct(owner: np.ndarray, code: np.ndarray, texts: int) -> np.ndarray:
    """Different codes of every text."""
    if not len(code):
        return np.zeros(texts)
    width = int(code.max()) + 1
    found = np.sort(owner * width + code)
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return np.bincount(found // width, minlength=texts).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of document statistics per text."""
    data, bounds = lexical.joined(column)
    texts, length = len(bounds) - 1, np.diff(bounds)
    kind = KIND[data]
    kinds = np.bincount(np.repeat(np.arange(texts) * KINDS, length) + kind, minlength=texts * KINDS).reshape(texts, KINDS)
    out = np.zeros((texts, STATISTICS))
    out[:, :KINDS] = kinds / np.maximum(length, 1)[:, None]

    starts, ends, first = lexical.words(data, bounds)
    count, of = np.diff(first), lexical.owners(first)
    per_word, size = np.maximum(count, 1), ends - starts
    dictionary, code = lexical.coded(data, starts, ends)
    code = code.astype(np.int64)
    neighbours = of[1:] == of[:-1]
    pairs = (code[:-1] * len(dictionary) + code[1:])[neighbours]
    line_starts, line_ends, line_first = lexical.runs(kind != 4, bounds)
    lines = np.diff(line_first)
    _, line_code = lexical.coded(data, line_starts, line_ends)
    longest = np.zeros(texts)
    if len(size):
        longest[count > 0] = np.maximum.reduceat(size, first[:-1][count > 0])
    out[:, KINDS:] = np.column_stack([
        np.log1p(count),
        np.bincount(of, size, texts) / per_word,
        np.log1p(longest),
        _distinct(of, code, texts) / per_word,
        _distinct(of[1:][neighbours], pairs, texts) / np.maximum(count - 1, 1),
        np.bincount(of, size <= 3, texts) / per_word,
        np.bincount(of, kind[starts] == 0, texts) / per_word,
        np.bincount(of, (kind[ends - 1] >= 7) & (kind[ends - 1] <= 9), texts) / per_word,
        np.log1p(lines),
        _distinct(lexical.owners(line_first), line_code.astype(np.int64), texts) / np.maximum(lines, 1),
        count / np.maximum(lines, 1),
    ])
    return out


@dataclass(frozen=True)
class Trees:
    """Flattened trees; node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    column: np.ndarray     # trees x inner nodes
    above: np.ndarray      # a row goes right if its column is above this
    leaf: np.ndarray       # trees x leaves
    base: float

    @property
    def depth(self) -> int:
        return self.leaf.shape[1].bit_length() - 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.column))[None, :]
        node = np.zeros((len(rows), len(self.column)), np.int64)
        row = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[row, self.column[tree, node]] > self.above[tree, node])
        margin = self.base + self.leaf[tree, node - self.column.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
         rate: float = 0.15, weight: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels under logistic loss.

    ``weight`` is the least sum of second derivatives a leaf may hold.
    """
    count, columns = rows.shape
    edges = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(columns)]
    binned = np.column_stack([np.searchsorted(edges[c], rows[:, c]) for c in range(columns)])
    flat = binned + np.arange(columns) * bins
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(count, base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    column = np.zeros((trees, inner), np.int64)
    above = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - labels, p * (1 - p)
        node = np.zeros(count, np.int64)
        for level in range(depth):
            nodes, offset = 2 ** level, 2 ** level - 1
            cell = ((node - offset)[:, None] * columns * bins + flat).ravel()
            shape = (nodes, columns, bins)
            g = np.bincount(cell, np.repeat(slope, columns), nodes * columns * bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(curve, columns), nodes * columns * bins).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < weight) | (h_all - h < weight)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for n in range(nodes):
                c, b = divmod(int(best[n]), bins)
                if gain[n, c, b] > 1e-6 and b < len(edges[c]):
                    column[t, offset + n], above[t, offset + n] = c, edges[c][b]
            node = 2 * node + 1 + (rows[np.arange(count), column[t, node]] > above[t, node])
        at = node - inner
        g, h = np.bincount(at, slope, leaves), np.bincount(at, curve, leaves)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, at]
    return Trees(column, above, leaf, base)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 16_384, label: str = "quality", **shape) -> Trees | None:
    """Trees from a bounded sample of labelled documents; None without labels.

    ``labels`` has ``doc_id`` and ``label``. At most ``sample_rows`` of them are
    used, those that come first in a fixed shuffle of the ids, and of documents
    with one id that whose text comes first, so that the broadcast of ids and the
    rows sent to the driver are bounded.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            columns = [pa.array(c) for c in found.T]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], names)

    names = ["label", *(f"s{i}" for i in range(STATISTICS))]
    table = sample.mapInArrow(rows, "label int, " + ", ".join(f"{n} double" for n in names[1:])).toPandas()
    if table.empty:
        return None
    # The order in which tasks answer must not change sums.
    table = table.sort_values(names, ignore_index=True)
    return grow(table[names[1:]].to_numpy(), table["label"].to_numpy(float), **shape)


def score(documents: DataFrame, trees: Trees | None, keep: float | None = None) -> DataFrame:
    """The documents with a ``score``; with ``keep``, only those that reach it,
    and without the score column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column("text"))
            found = np.ones(len(rows)) if trees is None else trees.score(rows)
            if keep is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])
            else:
                yield batch.filter(pa.array(found >= keep))

    schema = documents.schema if keep is not None else documents.drop("score").schema.add("score", "double")
    return (documents if keep is not None else documents.drop("score")).mapInArrow(run, schema)


def held_out(folds: int = 4, fold: int = 2, key: str = "doc_id") -> Column:
    """Whether a document's label stays unseen: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))

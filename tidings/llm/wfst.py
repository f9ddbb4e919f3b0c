"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into three parts: the normaliser (spaces to the word
mark, mark in front), the lexicon (a trie of pieces whose paths give piece ids)
with a fallback arc from any character without a piece to its bytes, and, for
models trained by merging, an acceptor of piece neighbours. Composed with an
input that is a lattice of pieces over its characters; the encoding is its
shortest path in the tropical semiring (weights add along a path, the least path
counts). Weights of a unigram model are negated scores. A merging model has
weights zero and infinity: two neighbours are allowed if merging their joined
text, best score first and leftmost among equals, ends with just these two. The
merged encoding of a text is the one path all of whose neighbours are allowed,
since a merge over a boundary depends on nothing but the two pieces at it.

No piece crosses certain places of a text (before a word mark, around a
character that occurs in single pieces only). Paths are therefore found for the
stretches between these, and remembered up to a bound.

Defined results: a null text has null ids, an empty one none. Word marks in a text
come back as spaces; all else is restored exactly by byte fallback, also
characters no piece has. Texts of any length are encoded whole. Rows are
treated one by one. Only ``text`` is read; a column ``ids`` or ``restored`` of
the input is replaced.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidings.llm.bitpack import Memory, portions

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGING = 1, 2
#: Below the worst score of a unigram model, the weight of a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Text that an unknown id decodes to.
UNKNOWN_SURFACE = " ⁇ "


class Transducer(Memory):
    """A compiled model."""

    #: Stretches and pairs of neighbours remembered in a worker.
    REMEMBERED, PAIRS = 900_000, 800_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        super().__init__()
        with open(path, "rb") as file:
            model = schema.ModelProto.FromString(file.read())
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("models with a character map are not supported")
        if model.trainer_spec.model_type not in (UNIGRAM, MERGING):
            raise ValueError("only unigram and merging models have pieces of text")
        self.merging = model.trainer_spec.model_type == MERGING
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.pieces = [(p.piece, p.type) for p in model.pieces]
        self.unknown = next(i for i, (_, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.bytes = {int(text[1:-1], 16): i for i, (text, kind) in enumerate(self.pieces) if kind == BYTE}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED)}
        self.ids = {text: i for i, (text, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # The lexicon: a trie over characters, each with the piece it ends, if any, and the state behind it.
        self.start: dict[str, list] = {}
        for text, i in self.ids.items():
            state = self.start
            for character in text:
                arc = state.setdefault(character, [None, {}])
                state = arc[1]
            arc[0] = i
        self.controls = {i for i, (_, kind) in enumerate(self.pieces) if kind == CONTROL}
        self.surfaces = [bytes([int(text[1:-1], 16)]) if kind == BYTE else (UNKNOWN_SURFACE if kind == UNKNOWN else text).encode()
                         for text, kind in self.pieces]
        self.stretch = self._stretches()
        if self.merging and not set("".join(self.ids)) <= set(self.ids):
            raise ValueError("a merging model needs a piece for every character of its pieces")
        self.allowed: dict[int, float] = {}

    def _stretches(self) -> re.Pattern:
        longer = [text for text in self.ids if len(text) > 1]
        inner = "".join(sorted(set("".join(longer)) - {MARK}))
        inner = f"[{re.escape(inner)}]" if inner else "(?!)"
        if any(MARK in text.lstrip(MARK) for text in longer):
            # Pieces reach over the mark: only characters without longer pieces cut.
            return re.compile(f"(?:{MARK}|{inner})+|[^{MARK}]", re.DOTALL)
        return re.compile(f"{MARK}+{inner}*|{inner}+|.", re.DOTALL)

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (" " + text if self.prefix and text else text).replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best-scored neighbours until none are left to merge."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, before: int, piece: int) -> float:
        """Of an arc with this piece after another one (``unknown``: a character without
        a piece, or none); infinite if they cannot meet."""
        if not self.merging:
            return -self.scores.get(self.pieces[piece][0], self.worst)
        # Nothing merges with a character without a piece, so its neighbour is judged by itself.
        pair = before * len(self.pieces) + piece
        weight = self.allowed.get(pair)
        if weight is None:
            expected = [self.pieces[i][0] for i in (before, piece) if i != self.unknown]
            weight = 0.0 if self.merged("".join(expected)) == expected else math.inf
            if len(self.allowed) < self.PAIRS:
                self.allowed[pair] = weight
        return weight

    def arcs(self, stretch: str, at: int) -> list[tuple[int, int]]:
        """Places that a piece from here reaches, nearest first, and the piece."""
        out, state = [], self.start
        for to in range(at, len(stretch)):
            arc = state.get(stretch[to])
            if arc is None:
                break
            piece, state = arc
            if piece is not None:
                out.append((to + 1, piece))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, self.unknown))
        return out

    def path(self, stretch: str) -> list[str]:
        """Pieces on the shortest path over a stretch; characters without a piece stand for themselves."""
        end, none = len(stretch), self.unknown
        last, back = [none] * (end + 1), [0] * (end + 1)
        if self.merging:
            # Finite weights are all zero: the first path found is a shortest one, so the search goes deep, longest pieces
            # first, and weighs an arc only when it comes to it. A place once reached is not reached for less.
            reached, trail = bytearray(end + 1), [(0, self.arcs(stretch, 0))] if end else []
            allowed, size, weight = self.allowed, len(self.pieces), self.weight
            while trail:
                at, open_arcs = trail[-1]
                if not open_arcs:
                    trail.pop()
                    continue
                to, piece = open_arcs.pop()
                if reached[to]:
                    continue
                before = last[at]
                cost = allowed.get(before * size + piece)
                if (weight(before, piece) if cost is None else cost) == 0.0:
                    reached[to], last[to], back[to] = 1, piece, at
                    if to == end:
                        break
                    trail.append((to, self.arcs(stretch, to)))
        else:
            cost = [0.0] + [math.inf] * end
            for at in range(end):
                for to, piece in self.arcs(stretch, at):
                    total = cost[at] + self.weight(last[at], piece)
                    if total < cost[to]:
                        cost[to], last[to], back[to] = total, piece, at
        out, at = [], end
        while at:
            out.append(stretch[back[at]:at])
            at = back[at]
        return out[::-1]

    def output(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character without one."""
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def _encoded(self, stretches: list[str]) -> list[bytes]:
        return [np.array([i for piece in self.path(s) for i in self.output(piece)], np.int32).tobytes() for s in stretches]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and how many each text has."""
        out = []
        for part in portions(texts):
            stretches = [self.stretch.findall(self.normalised(t)) for t in part]
            of = self.of(set().union(*stretches), self._encoded).__getitem__
            out += [b"".join(map(of, own)) for own in stretches]
        return np.frombuffer(b"".join(out), np.int32), np.array([len(ids) // 4 for ids in out], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        # Pieces of text begin with a whole character, so what is joined is read as each run by itself; control pieces have no text, but divide runs.
        runs = [ids] if self.controls.isdisjoint(ids) else [list(run) for control, run in itertools.groupby(ids, self.controls.__contains__) if not control]
        text = "".join(b"".join(map(self.surfaces.__getitem__, run)).decode(errors="replace") for run in runs)
        return text.removeprefix(MARK if self.prefix else "").replace(MARK, " ")


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled model for each Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encoded_batch(compiled: Transducer, batch: pa.RecordBatch, others: list[str], check: bool) -> pa.RecordBatch:
    """The other columns, the ids of ``text`` and, with ``check``, whether they decode to it."""
    texts = batch.column("text").to_pylist()
    there = np.array([t is not None for t in texts], bool)
    flat, sizes = compiled.encode_all([t for t in texts if t is not None])
    bounds = np.zeros(len(texts) + 1, np.int32)
    bounds[1:][there] = sizes
    bounds = np.cumsum(bounds, dtype=np.int32)
    columns, names = [*(batch.column(c) for c in others), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat), mask=pa.array(~there))], [*others, "ids"]
    if check:
        columns.append(pa.array([t is None or compiled.decode(flat[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, bounds, bounds[1:])], pa.bool_()))
        names.append("restored")
    return pa.RecordBatch.from_arrays(columns, names)


def encode(documents: DataFrame, model: str, check: bool = False) -> DataFrame:
    """The documents' columns but ``text``, and ``ids``; with ``check``, also ``restored``:
    whether decoding the ids gives the text again.

    ``model`` is the path of a model file, readable on every executor.
    """
    added = ["ids", *(["restored"] if check else [])]
    others = [c for c in documents.columns if c not in ("text", *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(model)
        for batch in batches:
            yield encoded_batch(compiled, batch, others, check)

    schema = documents.select(*others).schema.add("ids", T.ArrayType(T.IntegerType()))
    return documents.select(*others, "text").mapInArrow(run, schema.add("restored", "boolean") if check else schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns but ``ids``, and ``text``; null ids give a null text."""
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(model)
        for batch in batches:
            texts = [None if i is None else compiled.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return encoded.select(*others, "ids").mapInArrow(run, encoded.select(*others).schema.add("text", "string"))

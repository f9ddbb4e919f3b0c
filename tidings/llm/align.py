"""Alignment of two tokenizers' ids of the same text, split at white-space anchors.

Every text is encoded whole by a byte-level tokenizer (A, given a space and the
text) and by a SentencePiece model (B, which puts a space in front itself). Where
the bytes of both sides' tokens join to that text, places where a token ends on
both sides are shared ends. A shared end before tokens that start with a space
on both sides is an anchor; anchors cut a document into windows of ids of a few
tokens. A window is aligned once for each pair of id tuples and remembered, up to a
bound; where a text is words between single spaces, each word is a window, and is
encoded and aligned once for its text. A window's shared ends cut it into groups,
and tokens whose bytes overlap are linked. Sorted by their ends, two tokens overlap if the later one starts before
the earlier one ends, so a group of m and n tokens has m + n - 1 links.

How often the corpus links two ids is one aggregation over the documents' own
counts. The most frequent pairs (at most ``FREQUENT``, 17 bytes each) are looked
up in every task; all other pairs by a join, in which none is a hot key, as each
has less than a ``FREQUENT``-th of all links.

Defined results: a text that is null or empty, or that one of the sides does not
restore byte for byte (a word mark in the text), has no tokens: counts of zero and
an empty string for the hash. Special tokens' strings are plain text. Rows are
treated one by one, also those of equal or null id. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import array
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.bitpack import Encoder, Memory, portions
from tidings.llm.store import written

SPACE = 0x20
#: Pairs held by every task.
FREQUENT = 1 << 18
#: Bytes of text treated together, beyond which a group of documents is closed.
GROUP_BYTES = 4 << 20


class PlainEncoder(Encoder):
    """A byte-level tokenizer for which no text is special."""

    #: White space before a space, where no piece need begin at the space.
    BROKEN = re.compile(f"[{Encoder.SPACE}] ")
    # Less than the encoder alone may hold: other memories stand beside this one.
    REMEMBERED = 100_000

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = re.compile(r"(?!)")

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id."""
        # Printable bytes stand for themselves, the others for characters from 256 on, in order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        return [added[i] if i in added else bytes(byte[c] for c in self.tokenizer.id_to_token(i)) for i in range(self.size)]


class PieceEncoder(Memory):
    """A SentencePiece model, with a bounded memory of stretches.

    A stretch is spaces and all up to the next space. Where no piece has the word
    mark behind another character, none reaches from one stretch into the next,
    so a stretch met before needs no second encoding. Texts that hold a word mark
    of their own or end in a space are encoded whole, and so are all texts of other models.
    """

    STRETCH = re.compile(" +[^ ]*")
    #: Stretches encoded as one text.
    REMEMBERED, TOGETHER = 100_000, 128

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        with open(path, "rb") as file:
            spec = schema.ModelProto.FromString(file.read())
        how = spec.normalizer_spec
        self.stretches = (how.add_dummy_prefix and not how.remove_extra_whitespaces and not how.precompiled_charsmap
                          and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces))
        self.spaced = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(self.size)], bool)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, np.uint32).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _stretches(self, text: str) -> list[str]:
        """Without the space in front, which the model puts there itself."""
        if "  " in text or text[0] == " ":
            return [s[1:] for s in self.STRETCH.findall(" " + text)]
        return text.split(" ")

    def encoded_stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches. Many without spaces stand in one text, whose ids are cut before each space again."""
        plain = [s for s in stretches if s and " " not in s]
        others = [s for s in stretches if not s or " " in s]
        texts = [plain[at:at + self.TOGETHER] for at in range(0, len(plain), self.TOGETHER)]
        found = dict(zip(others, self._encoded(others)))
        for own, ids in zip(texts, self._encoded([" ".join(own) for own in texts])):
            starts = (4 * np.flatnonzero(self.spaced[np.frombuffer(ids, np.uint32)])).tolist()
            found |= zip(own, map(ids.__getitem__, map(slice, starts, [*starts[1:], None]))) if len(starts) == len(own) else zip(own, self._encoded(own))
        return [found[s] for s in stretches]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for part in portions(texts):
            whole = [t for t in part if not self.stretches or "▁" in t or t.endswith(" ")]
            apart = dict(zip(whole, self._encoded(whole)))
            stretches = [None if t in apart else self._stretches(t) for t in part]
            of = self.of(set().union(*filter(None, stretches)), self.encoded_stretches).__getitem__
            out += [np.frombuffer(apart[t] if own is None else b"".join(map(of, own)), np.uint32) for t, own in zip(part, stretches)]
        return out

    def token_bytes(self) -> list[bytes]:
        def of(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

        return [of(i) for i in range(self.size)]


#: Marks ids of the second side where both sides' ids stand in one row.
SECOND = 1 << 31
#: A word's tokens on both sides, its groups as text, their number and its links in bytes; empty if a side does not restore it.
Word = tuple[int, int, bytes, int, bytes] | tuple[()]
#: A window's groups as text, their number, its links in bytes, and its text if both sides restore the same.
Window = tuple[bytes, int, bytes, bytes | None]


class Aligner:
    """Both tokenizers, and the windows met so far."""

    #: Windows remembered in a worker, and the most tokens of one that is.
    REMEMBERED, SHORT = 200_000, 64
    #: Words remembered in a worker.
    WORDS = 500_000

    def __init__(self, byte_level: str, pieces: str):
        self.sides = (PlainEncoder(byte_level), PieceEncoder(pieces))
        self.bytes = [side.token_bytes() for side in self.sides]
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in self.bytes]
        self.spaced = [np.array([t[:1] == b" " for t in table], bool) for table in self.bytes]
        self.sizes = [lengths.tolist() for lengths in self.lengths]
        self.names = [[str(i) for i in range(side.size)] for side in self.sides]
        self.words = Memory()
        self.words.REMEMBERED = self.WORDS
        # By the ids of both sides in a row.
        self.known: dict[bytes, Window] = {}
        self.older: dict[bytes, Window] = {}

    def _window(self, key: bytes) -> Window:
        """A window met before or aligned now."""
        found = self.older.get(key)
        if found is None:
            ids = memoryview(key).cast("I").tolist()
            found = self._aligned([i for i in ids if i < SECOND], [i - SECOND for i in ids if i >= SECOND])
        if len(key) <= 4 * self.SHORT:
            self.known[key] = found
        return found

    def _aligned(self, a: list[int], b: list[int]) -> Window:
        text_a, text_b = (b"".join(map(table.__getitem__, ids)) for table, ids in zip(self.bytes, (a, b)))
        return *self._cut(a, b), text_a if text_a == text_b else None

    def _cut(self, a: list[int], b: list[int]) -> tuple[bytes, int, bytes]:
        """Groups as text, their number, and links in bytes of ids that have equally many bytes on both sides."""
        size_a, size_b, ids_b, (name_a, name_b) = *self.sizes, self.sides[1].size, self.names
        x, y, i, j = a[0], b[0], 0, 0
        end_a, end_b, left, right = size_a[x], size_b[y], name_a[x], name_b[y]
        groups, links = [], [x * ids_b + y]
        while True:
            # The token that ends first makes way for the next of its side; every token has bytes.
            if end_a < end_b:
                i += 1
                x = a[i]
                end_a += size_a[x]
                left += "," + name_a[x]
            elif end_b < end_a:
                j += 1
                y = b[j]
                end_b += size_b[y]
                right += "," + name_b[y]
            else:
                groups.append(left + "|" + right)
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                x, y = a[i], b[j]
                end_a, end_b, left, right = end_a + size_a[x], end_b + size_b[y], name_a[x], name_b[y]
            links.append(x * ids_b + y)
        return ";".join(groups).encode(), len(groups), array.array("q", links).tobytes()

    def _aligned_words(self, words: list[str]) -> list[Word]:
        """Each is a window: a space in front of it begins a token on both sides, and it has no other."""
        out: list[Word] = []
        of_a, of_b = (table.__getitem__ for table in self.bytes)
        spaced = [" " + word for word in words]
        for text, a, b in zip(spaced, self.sides[0].encoded_pieces(spaced), self.sides[1].encoded_stretches(words)):
            a, b = memoryview(a).cast("I").tolist(), memoryview(b).cast("I").tolist()
            sound = b"".join(map(of_a, a)) == text.encode() == b"".join(map(of_b, b))
            out.append((len(a), len(b), *self._cut(a, b)) if sound else ())
        return out

    def _plain(self, text: str) -> bool:
        """Whether both sides begin a token at every space, and only there."""
        side = self.sides[0]
        return (self.sides[1].stretches and text[0] != " " and text[-1] != " " and not side.BROKEN.search(text)
                and not side.OTHER.search(text) and not side.special.search(text))

    def by_words(self, texts: list[str]) -> list[list[Word] | None]:
        """The windows of texts that are words between single spaces, where both sides restore them all."""
        out: list[list[Word] | None] = []
        for some in portions(texts):
            words = [t.split(" ") if self._plain(t) else None for t in some]
            of = self.words.of(set().union(*filter(None, words)), self._aligned_words).__getitem__
            found = [None if own is None else [*map(of, own)] for own in words]
            out += [own if own and all(own) else None for own in found]
        return out

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both sides' ids of each text, none where they have not the bytes for it."""
        sides = zip(self.sides[0].ids([" " + t for t in texts]), self.sides[1].ids(texts))
        return [ids if all(lengths[i].sum() == 1 + len(t.encode()) for lengths, i in zip(self.lengths, ids)) else None
                for t, ids in zip(texts, sides)]

    def windows(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> list[list[Window]]:
        """The windows of each text."""
        flat = [np.concatenate(side) for side in zip(*ids)]
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(self.lengths, flat)]
        # Every text starts with a space, so its start is an anchor like any other.
        place = np.zeros(ends[0][-1] + 1, np.uint8)
        for bit, side_ends in enumerate(ends):
            before_space = np.append(self.spaced[bit][flat[bit]][1:], True)
            place[side_ends[before_space]] |= 1 << bit
        cuts = [np.flatnonzero(place[side_ends] == 3) + 1 for side_ends in ends]
        # Of each window the ids of the one side, then those of the other.
        sizes = [np.diff(c, prepend=0) for c in cuts]
        row = np.empty(len(flat[0]) + len(flat[1]), np.uint32)
        row[np.arange(len(flat[0])) + np.repeat(cuts[1] - sizes[1], sizes[0])] = flat[0]
        row[np.arange(len(flat[1])) + np.repeat(cuts[0], sizes[1])] = flat[1] | np.uint32(SECOND)
        raw, bounds, known = row.tobytes(), (4 * (cuts[0] + cuts[1])).tolist(), self.known
        found = [w if (w := known.get(key := raw[s:e])) is not None else self._window(key) for s, e in zip([0, *bounds], bounds)]
        until = np.searchsorted(cuts[0], np.cumsum([len(a) for a, _ in ids]), "right").tolist()
        return [found[s:e] for s, e in zip([0, *until], until)]

    def align(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """``n_a, n_b, n_groups, n_links, groups_sha256`` of each text; then bounds of each text's
        different links, the links (as one number each) and how often the text has them."""
        if len(self.known) > self.REMEMBERED // 2:
            # What was not met since the last time goes.
            self.known, self.older = {}, self.known
        rows, links = [(0, 0, 0, 0, "")] * len(texts), [b""] * len(texts)
        solid = [at for at, text in enumerate(texts) if text]
        words = dict(zip(solid, self.by_words([texts[at] for at in solid])))
        for at in solid:
            if words[at]:
                n_a, n_b, groups, counts, found = zip(*words[at])
                links[at] = b"".join(found)
                rows[at] = (sum(n_a), sum(n_b), sum(counts), len(links[at]) // 8, hashlib.sha256(b";".join(groups)).hexdigest())
        solid = [at for at in solid if not words[at]]
        ids = dict(zip(solid, self.encoded([texts[at] for at in solid])))
        solid = [at for at in solid if ids[at] is not None]
        for at, windows in zip(solid, self.windows([ids[at] for at in solid]) if solid else []):
            groups, counts, found, parts = zip(*windows)
            # The shared ends are right if the bytes between them are, on both sides.
            if None not in parts and b"".join(parts) == b" " + texts[at].encode():
                links[at] = b"".join(found)
                rows[at] = (*map(len, ids[at]), sum(counts), len(links[at]) // 8, hashlib.sha256(b";".join(groups)).hexdigest())
        owner = np.repeat(np.arange(len(texts)), [len(found) // 8 for found in links])
        pairs = self.sides[0].size * self.sides[1].size
        different, often = np.unique(owner * pairs + np.frombuffer(b"".join(links), np.int64), return_counts=True)
        owner, different = np.divmod(different, pairs)
        return rows, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))), different, often


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each Python worker and pair of files."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _close(texts: list[str]) -> Iterator[slice]:
    """Groups of neighbours that hold a bounded number of bytes, or one text."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += 4 * len(text or "")
        if held > GROUP_BYTES or at == len(texts) - 1:
            yield slice(start, at + 1)
            start, held = at + 1, 0


def aligned(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the different links ``pairs`` with their counts ``often``."""
    names = ["doc_id", *COUNTS, "groups_sha256", "pairs", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_level, pieces)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _close(texts):
                rows, bounds, links, often = both.align(texts[part])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()),
                    _lists(bounds, links), _lists(bounds, often)], names)

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>, often array<long>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(documents: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best`` over the corpus; ``best`` pairs have the highest count of their id in B."""
    exploded = documents.select(F.explode(F.arrays_zip("pairs", "often")).alias("link")).select("link.*")
    counts = written(exploded.groupBy(F.col("pairs").alias("pair")).agg(F.sum("often").alias("count")), "pair-counts")
    counts = counts.withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return written(counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs in order, their counts and whether they are best; as many as whole steps of frequency allow."""
    step = F.floor(16 * F.log2("count"))
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, math.inf
    for row in sizes:
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    found = counts.where(step >= F.lit(float(least))).toArrow().sort_by("pair")
    return tuple(found.column(c).to_numpy() for c in ("pair", "count", "best"))


def alignment(documents: DataFrame, byte_level: str, pieces: str, most: int = FREQUENT) -> DataFrame:
    """``doc_id``, the counts of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256`` for every row.

    The paths name a tokenizer file (A) and a SentencePiece model (B), readable on every executor.
    """
    spark = documents.sparkSession
    rows = written(aligned(documents, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, PieceEncoder(pieces).size)
    held = spark.sparkContext.broadcast(frequent(counts, most))
    kept = ["row", "doc_id", *COUNTS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = held.value
        for batch in batches:
            pairs, often = batch.column("pairs"), batch.column("often")
            sizes = np.diff(pairs.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs, often = pairs.flatten().to_numpy(), often.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, owner[hit], often[hit] * best[at[hit]])
            np.add.at(total, owner[hit], often[hit] * count[at[hit]])
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total), _lists(bounds, pairs[~hit]), _lists(bounds, often[~hit])],
                [*kept, "n_best", "count_sum", "pairs", "often"])

    fields = "row long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long"
    looked_up = written(rows.mapInArrow(run, f"{fields}, pairs array<long>, often array<long>"), "looked-up")
    rare = looked_up.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.often")
    rare = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("rare_best"), F.sum(F.col("often") * F.col("count")).alias("rare_sum"))
    more = lambda c, rare: (F.col(c) + F.coalesce(rare, F.lit(0).cast("long"))).alias(c)
    return looked_up.drop("pairs", "often").join(rare, "row", "left").select(
        "doc_id", *COUNTS, more("n_best", F.col("rare_best")), more("count_sum", F.col("rare_sum")), "groups_sha256")

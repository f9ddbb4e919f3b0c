"""Token ids in fixed-width bit-packed files, in ascending order of document.

A file is one byte string: a header, the documents' ids and ends, the byte
offset of every block, then blocks of ``BLOCK`` token ids of the least number of
bits that the vocabulary needs, most significant bit first. A block starts at a
whole byte, so any document's ids are found from its end, the end before it and
the offsets of the blocks between, and unpacked with numpy alone. Files are
rows of a table, so whatever store the session writes to will do, a
retried task replaces what it had written, and files stay small: one is closed
with the document that reaches ``FILE_IDS``.

Defined results: a null text counts as empty and holds the end id only. Rows
without an id come first and are marked as such; rows of equal id are in order
of text. An empty table gives no file. Only id and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.store import written

MAGIC = b"TIDPACK1"
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 8_192
FILE_IDS = 1 << 20
#: Stands for a null document id in a file.
NO_ID = -2**63


def width(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary of this size."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, most significant first, with zero bits up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    by_byte = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return by_byte[:, 4 - bits // 8:].tobytes()
    return np.packbits(np.unpackbits(by_byte, axis=1)[:, 32 - bits:]).tobytes()


def unpacked(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    found = np.frombuffer(data, np.uint8)
    out = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        out[:, 4 - bits // 8:] = found[:count * bits // 8].reshape(count, bits // 8)
    else:
        digits = np.zeros((count, 32), np.uint8)
        digits[:, 32 - bits:] = np.unpackbits(found, count=count * bits).reshape(count, bits)
        out = np.packbits(digits, axis=1)
    return out.view(">u4").ravel().astype(np.uint32)


def file_of(documents: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A whole file."""
    blocks = [packed(ids[at:at + BLOCK], bits) for at in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])
    names = np.array([NO_ID if d is None else d for d in documents], "<i8")
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK, len(names), len(ids)), names.tobytes(), ends.astype("<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), *blocks])


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, documents, self.count = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks = -(-self.count // self.block)
        at = HEADER.size
        self.documents = np.frombuffer(data, "<i8", documents, at)
        self.ends = np.frombuffer(data, "<u8", documents, at + 8 * documents).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 16 * documents).astype(np.int64)
        self.payload = memoryview(data)[at + 16 * documents + 8 * (blocks + 1):]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are unpacked."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        found = [unpacked(self.payload[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.count - b * self.block), self.bits)
                 for b in range(first, last + 1)]
        return np.concatenate(found)[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


#: Characters of text whose pieces are looked up together.
PORTION = 1 << 18


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Neighbours of ``PORTION`` characters or a little more, so that each different piece of theirs is looked up once."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= PORTION:
            yield part
            part, held = [], 0
    if part:
        yield part


class Memory:
    """What is known of parts of texts met before, such as their ids as bytes; what was not met for long is forgotten."""

    #: Parts remembered in a worker, beside those of the texts at hand.
    REMEMBERED = 600_000

    def __init__(self):
        self.known: dict = {}
        self.older: dict = {}

    def of(self, parts: set[str], encoded: Callable[[list[str]], list]) -> dict:
        """What is known of these parts, which are encoded if they are new."""
        if len(self.known) > self.REMEMBERED // 2:
            self.known, self.older = {}, self.known
        found = dict(zip(parts, map(self.known.get, parts)))
        fresh = [p for p, ids in found.items() if ids is None]
        if self.older:
            again = {p: ids for p, ids in zip(fresh, map(self.older.get, fresh)) if ids is not None}
            fresh = [p for p in fresh if p not in again]
        else:
            again = {}
        again.update(zip(fresh, encoded(fresh)))
        self.known |= again
        found |= again
        return found


class Encoder(Memory):
    """Ids of texts by a byte-level tokenizer file, with a bounded memory of pieces.

    The tokenizer splits a text by a pattern and encodes each piece by itself, so
    a piece met before needs no second encoding. Characters up to U+024F have
    had their classes since long before any library here; texts with others, or
    with a special token, are encoded whole.
    """

    # The tokenizer's split, with its classes spelt out up to U+024F.
    LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
    # Nothing else begins like a word, so words are tried first.
    PIECE = re.compile(
        f" ?[{LETTER}]+| ?[{NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{LETTER}{NUMBER}{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    OTHER = re.compile("[^\x00-ɏ]")
    BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0")
    #: Pieces encoded as one text.
    TOGETHER = 128

    def __init__(self, path: str):
        # Spark runs a task on each core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # No special token reaches over a space here.
        self.together = 1 if any(" " in t.content for t in self.tokenizer.get_added_tokens_decoder().values()) else self.TOGETHER
        # Byte-level files write a space as this character.
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)], bool)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, or of words with a space in front: many of either stand in one text, whose ids are cut before each space again."""
        joins = [len(p) > 1 and p[0] == " " and p[1] not in self.BLANK and p[-1] not in self.BLANK for p in pieces]
        plain, others = [p for p, join in zip(pieces, joins) if join], [p for p, join in zip(pieces, joins) if not join]
        found = dict(zip(others, self._encoded(others)))
        texts = [plain[at:at + self.together] for at in range(0, len(plain), self.together)]
        for own, ids in zip(texts, self._encoded(["".join(own) for own in texts])):
            starts = (4 * np.flatnonzero(self.spaced[np.frombuffer(ids, np.uint32)])).tolist()
            found.update(zip(own, map(ids.__getitem__, map(slice, starts, [*starts[1:], None])) if len(starts) == len(own) else self._encoded(own)))
        return [found[p] for p in pieces]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for some in portions(texts):
            whole = [t for t in some if self.OTHER.search(t) or self.special.search(t)]
            apart = dict(zip(whole, self._encoded(whole)))
            pieces = [None if t in apart else self.PIECE.findall(t) for t in some]
            of = self.of(set().union(*filter(None, pieces)), self.encoded_pieces).__getitem__
            out += [np.frombuffer(apart[t] if own is None else b"".join(map(of, own)), np.uint32) for t, own in zip(some, pieces)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILES = "part int, file int, n_ids long, data binary"


def write(documents: DataFrame, tokenizer: str, end_id: int, purpose: str = "packed-ids") -> DataFrame:
    """Files of all documents' ids, ``end_id`` after each; ``part, file`` are in order of document.

    ``tokenizer`` is the path of a tokenizer file, readable on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, file = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = width(max(encode.size, end_id + 1))
        names, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(texts)
            data = file_of(names, np.cumsum([len(t) for t in texts]), ids, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(ids)]), pa.array([data], pa.binary())],
                ["part", "file", "n_ids", "data"])

        for batch in batches:
            found = encode.ids([t or "" for t in batch.column("text").to_pylist()])
            for name, ids in zip(batch.column("doc_id").to_pylist(), found):
                names.append(name)
                texts.append(np.append(ids, np.uint32(end_id)))
                held += len(texts[-1])
                if held >= FILE_IDS:
                    yield close()
                    names, texts, held, file = [], [], 0, file + 1
        if names:
            yield close()

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, FILES), purpose)


def read(files: DataFrame, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, and its ``ids`` if asked for."""
    names = ["doc_id", "part", "file", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, data in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "data"))):
                reader = Reader(data)
                starts = np.concatenate(([0], reader.ends[:-1]))
                whole = reader.ids(0, reader.count)
                found = [whole[a:b] for a, b in zip(starts, reader.ends)]
                sums = [zlib.crc32(d.astype("<u4").tobytes()) for d in found]
                columns = [
                    pa.array(reader.documents, mask=reader.documents == NO_ID),
                    pa.array(np.full(len(starts), part, np.int32)), pa.array(np.full(len(starts), file, np.int32)),
                    pa.array(starts), pa.array(reader.ends - starts), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.array([d.astype(np.int32) for d in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, part int, file int, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    found = files.select("part", "file", "data").mapInArrow(run, schema)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return found.join(starts, ["part", "file"]).withColumn("start", F.col("before") + F.col("start")).drop("before", "part", "file")

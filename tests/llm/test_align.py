"""Alignment of two tokenizers, against byte ranges compared one by one."""

import collections
import functools
import hashlib

import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from tests.llm.tables import awkward, empty, tuples
from tidings.llm import align

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@functools.cache
def _tokenizers():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


@functools.cache
def _sides(text):
    """(id, start, end) of every token on both sides, none if they do not restore the text."""
    tokenizer, model = _tokenizers()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            byte[chr(256 + len(byte) - len(shown))] = b

    def placed(pairs):
        at, out = 0, []
        for i, raw in pairs:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    found = tokenizer.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(raw for _, raw in side) != whole for side in (a, b)):
        return [], []
    return placed(a), placed(b)


def _expected(rows):
    sides = [_sides(text) if text else ([], []) for _, text in rows]
    links = [[(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)] for a, b in sides]
    count = collections.Counter(pair for found in links for pair in found)
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (doc_id, _), (a, b), found in zip(rows, sides, links):
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, s, e in side if at < e <= end) for side in (a, b)))
            at = end
        out.append((doc_id, len(a), len(b), len(groups), len(found), sum(count[p] == best[p[1]] for p in found), sum(count[p] for p in found),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


TEXTS = ["one two  three", "a<|endoftext|>b", "mark ▁ inside", "▁", "\n\n x\t y \n", "naïve café 中文字符 😀 end", "x" * 500, " lead", "trail ", "0123456789 " * 40,
         "<0x41> <s> </s> <unk>", "it's we'll nbsp", "\u0000nul", "é combining", "ends here", "ends here", "", None, "中" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    r = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string")
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").select("doc_id", "text").selectExpr("*", "'c' AS pairs")
    return r.union(some.where("doc_id < 120"))


@pytest.mark.parametrize("most", [align.FREQUENT, 50, 0])
def test_alignment_is_that_of_all_byte_ranges(spark, docs, most):
    assert tuples(align.alignment(docs, A, B, most=most)) == _expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_remembered_windows_change_nothing(spark):
    """A worker that forgets after every group of documents gives the same."""
    texts = [t for t in TEXTS if t] * 2
    kept, forgetful = align.Aligner(A, B), align.Aligner(A, B)
    forgetful.REMEMBERED = 0
    for at in range(0, len(texts), 5):
        left, right = kept.align(texts[at:at + 5]), forgetful.align(texts[at:at + 5])
        assert left[0] == right[0] and all((x == y).all() for x, y in zip(left[1:], right[1:]))
    assert forgetful.older and not kept.older


def test_new_stretches_are_encoded_many_at_a_time():
    side, given = align.PieceEncoder(B), []
    encoded = side._encoded
    side._encoded = lambda some: given.extend(some) or encoded(some)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}中é" for i in range(500)) + "  two  spaces\nand a line"
    assert side.ids([text])[0].tolist() == side.model.encode(text) and len(given) < 20


def test_awkward_tables(spark):
    found = align.alignment(awkward(spark), A, B)
    assert found.count() == awkward(spark).count()
    assert found.where("n_a = 0 AND groups_sha256 <> ''").count() == 0
    assert found.where("n_a > 0 AND n_links <> n_a + n_b - n_groups").count() == 0
    assert align.alignment(empty(spark), A, B).count() == 0


def test_token_tables_give_the_text(spark):
    both = align.Aligner(A, B)
    for text in filter(None, TEXTS):
        for side, table, given in zip(both.sides, both.bytes, (" " + text, text)):
            joined = b"".join(table[i] for i in side.ids([given])[0].tolist())
            assert joined == (" " + text.replace("▁", " ") if side is both.sides[1] else " " + text).encode()

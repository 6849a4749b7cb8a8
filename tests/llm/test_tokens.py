"""Encoding, decoding and the binary files against the library, on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prevuelo.llm import bitpack, bpe
from prevuelo.llm.tokens import encoder, ids_of

ODD = [
    None, "", "a", " a", "a ", "  a b", "a\n b", "it's don't  'll x", "ünï çödé Straße", "<|endoftext|> hi <|startoftext|>",
    "日本 語 text", "é a", "a\x85b\xa0c", "A\tb", "\x1c x", "x" * 700, "ab" * 400 + "!?" * 300 + " end", "\n" * 500 + "x",
    " " * 300, "don't " * 200, "日本" * 300, "a1" * 400, "x" * 200 + "<|endoftext|>" + "y" * 200, "same", "same",
]


def le(ids):
    return np.array(ids, "<u4").tobytes()


def expected(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_helper_equals_library(name, request):
    path = request.getfixturevalue(name)
    assert encoder(path).encode(ODD) == [le(expected(path, t)[0]) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab e'st\n.!1é日"), max_size=120), st.integers(1, 9))
def test_leaves_equal_library(text, leaf):
    from prevuelo.llm.queries import tokenizer

    enc = encoder(tokenizer("byte_bpe_50k.json"))
    cut = list(bpe.leaves(enc, text, leaf))
    assert "".join(t for _, t in cut) == text
    got = bpe.assemble(enc, [k for k, _ in cut], [bpe.encode_leaf(enc, k, t) for k, t in cut])
    assert got == enc.whole([text])[0]


@pytest.mark.parametrize("white", ["\n", "\n\n", "\n\n\n\n", " \n", "\t\t", "  \n\n", "\u00a0\n", "\r\n\r\n", "\u2028\n", "\x1c\x1c"])
def test_white_space_around_unsplit_stretches(byte_bpe, white):
    enc, blob = encoder(byte_bpe), "abcdefgh" * 4000
    for text in [
        "x" * 20_000 + white + blob + " end",
        white + blob + white + blob + white,
        "one two" + white + blob + white + "7" * 40_000 + white + "three, four",
        "!" * 18_000 + white + blob + "\n" * 20_000 + blob,
    ]:
        cut = list(bpe.leaves(enc, text))
        assert "".join(t for _, t in cut) == text and any(k == bpe.NEXT for k, _ in cut)
        got = bpe.assemble(enc, [k for k, _ in cut], [bpe.encode_leaf(enc, k, t) for k, t in cut])
        assert got == enc.whole([text])[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\n", "\n\n", " ", "\t", "abcdefgh", "é!?", "12345", "日本日本日本", "x"]), max_size=30), st.integers(1, 6))
def test_white_space_and_stretches_at_small_leaves(parts, leaf):
    from prevuelo.llm.queries import tokenizer

    enc, text = encoder(tokenizer("byte_bpe_50k.json")), "".join(parts)
    cut = list(bpe.leaves(enc, text, leaf))
    got = bpe.assemble(enc, [k for k, _ in cut], [bpe.encode_leaf(enc, k, t) for k, t in cut])
    assert "".join(t for _, t in cut) == text and got == enc.whole([text])[0]


def test_unsplit_text_is_joined_exactly(byte_bpe):
    enc, rng = encoder(byte_bpe), random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice(["the", "ing", "a", "t", "he", "x", "tion"]) for _ in range(rng.randint(2, 80)))
        size = rng.randint(1, 12)
        parts = [enc.merge(raw[i : i + size].encode()) for i in range(0, len(raw), size)]
        assert bpe.concatenate(parts, enc.merge, enc.token_bytes) == enc.merge(raw.encode())


def test_encode_decode_rows(spark, byte_bpe):
    rows = [(i if i else None, t, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(df, byte_bpe, ["doc_id"], leaf=64)
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.decode(coded, byte_bpe).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids, tok = expected(byte_bpe, t)
        want.append((i, le(ids), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


def test_op1_digests(spark, byte_bpe):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in bpe.op1(df, byte_bpe).collect():
        ids, tok = expected(byte_bpe, ODD[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(le(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op1(df.limit(0), byte_bpe).count() == 0


def test_whole_bytes_are_packed_alike():
    ids = np.random.default_rng(3).integers(0, 1 << 16, 4096, dtype=np.uint32)
    want = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :16].ravel(), bitorder="little")
    assert bitpack.pack(ids, 16) == want.tobytes()
    want = np.packbits(np.unpackbits((ids & 8191).astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :13].ravel(), bitorder="little")
    assert bitpack.pack(ids & 8191, 13) == want.tobytes()


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 15, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 9001, dtype=np.uint64).astype(np.uint32)
    raw = bitpack.pack(ids, bits)
    assert len(raw) == 3 * bitpack.BLOCK * bits // 8
    assert (bitpack.unpack(raw, bits)[:9001] == ids).all()


def test_random_access(tmp_path):
    ids = np.random.default_rng(2).integers(0, 50_000, 30_000, dtype=np.uint32)
    raw = ids.astype("<u4").tobytes()
    path = tmp_path / "a.ids"
    path.write_bytes(bitpack.dump([7, None], [raw[:40_000], raw[40_000:]], 16))
    file = bitpack.IdFile(f"file://{path}")
    assert file.doc_ids.tolist() == [7, 0] and file.named.tolist() == [True, False]
    for a, n in [(0, 1), (4095, 2), (12_288, 4096), (29_999, 1), (5, 0), (0, 30_000)]:
        assert (file.read(a, n) == ids[a : a + n]).all()
    file.close()


def test_op10_rows(spark, byte_bpe):
    rows = [(None, "null id", 1), *[(50 - i, t, 1) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    got = sorted((tuple(r) for r in bitpack.op10(df, byte_bpe).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = expected(byte_bpe, t)[0] + [2]
        want.append((i, start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    assert got == want
    assert bitpack.op10(df.limit(0), byte_bpe).count() == 0

"""Fill-in-the-middle, spelling variants and SentencePiece against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from prevuelo.llm import fim, pieces, spelling
from prevuelo.llm.queries import tokenizer

# fill in the middle


def cut_by_hand(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a\n<PSM>é日\r "), max_size=60), st.integers(0, 10**6), st.integers(1, 9))
def test_piece_table(text, doc_id, block):
    before, fim._BLOCK = fim._BLOCK, block
    try:
        made = fim.transformed(memoryview(text.encode()), doc_id, "7", 100, 50)
        out = made.table.bytes()
        assert (made.n, made.form, made.prefix_chars, made.middle_chars, out.decode()) == cut_by_hand(text, doc_id)
        assert made.table.sha256() == hashlib.sha256(out).hexdigest()
        back = fim.PieceTable.of(memoryview(out))
        back = back.restore(fim.ORDERS[made.form]) if made.form != "plain" else back
        assert back.bytes() == text.encode()
    finally:
        fim._BLOCK = before


def test_cuts_split_descriptors_anywhere():
    table = fim.PieceTable.of(memoryview(b"abcdef")).cut(2, 4)
    assert [bytes(p) for p in table] == [b"ab", b"cd", b"ef"]
    assert [bytes(p) for p in table.cut(1, 5)] == [b"a", b"b", b"cd", b"e", b"f"]
    assert [bytes(p) for p in table.arrange((2, 0, 1))] == [b"<S>", b"ef", b"<P>", b"ab", b"<M>", b"cd"]
    assert [bytes(p) for p in fim.PieceTable.of(memoryview(b"ab")).cut(0, 2)] == [b"", b"ab", b""]


def test_fill_in_middle_rows(spark):
    texts = [None, "", "one line", "a\nb\nc\n", "\n\n\n", "x<S>y\nz", "é\n日本\n" * 5000, "a\r\nb", "same\nrow", "same\nrow"]
    rows = [(None if i == 8 else i // 2, t, "mine", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, output string, `_id` string")
    made = fim.transform(df, ["doc_id", "_id"], output="out")
    assert made.columns == ["doc_id", "_id", "n", "form", "prefix_chars", "middle_chars", "out", "out_sha256"]
    back = fim.restore(made, made.columns, output="out")
    got = back.collect()
    want = [(i, *cut_by_hand(t or "", i), t or "") for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.out, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.out_sha256 == hashlib.sha256(r.out.encode()).hexdigest() for r in got)
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)
    assert {r.form for r in fim.transform(df, ["doc_id"], rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(df, ["doc_id"], spm=100).collect()} == {"plain", "spm"}
    assert fim.op11(df).count() == len(rows) and fim.op11(df.limit(0)).count() == 0


# spelling


def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if near_by_hand(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def corpus(rng, n_docs, letters="abcdeéz"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(30)]

    def typed(w):
        at = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :], w.upper()])

    return [(i, " ".join(typed(base[min(rng.randrange(30), rng.randrange(30))]) for _ in range(rng.randint(0, 60)))) for i in range(n_docs)]


@pytest.mark.parametrize("most, first", [(20_000, 5), (40, 2), (6, 3)])
def test_spelling_rows(spark, most, first):
    rows = corpus(random.Random(most), 150)
    rows += [(None, None), (7, ""), (8, "ÀÉÎÕÜÿ àéîõüÿ × ÷÷÷÷÷÷÷ Straße Straße"), (9, "abcdef " * 300 + "fedcba " * 9), (9, "abcdef " * 300), (10, "q" * 5000 + " " + "aaaaaa ab" * 40)]
    rows.append((11, "planket " * 5 + "blanket " * 30 + "blankets " * 160))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    vocabulary = spelling.written(spelling.words(df), "words")
    found = spelling.forms(vocabulary, spelling.near_pairs(vocabulary, most=most, first=first))
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
    assert got == spelling_by_hand(rows)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_spelling_of_many_orders_of_the_same_letters(spark):
    """All levels leave these in one cell; they are dealt in parts."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(12)) for _ in range(900)})
    vocabulary = spark.createDataFrame([(w, 5 + i % 40) for i, w in enumerate(words)], "word string, n long")
    got = {tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(vocabulary, most=60).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near_by_hand(a, b)}
    assert spelling.near_pairs(vocabulary, most=60).count() == len(got)


def test_trie_search_alone(monkeypatch):
    rng = random.Random(6)
    for small in (4096, 4, 0):
        monkeypatch.setattr(spelling, "_SMALL", small)
        words = sorted({"".join(rng.choice("abcyzé") for _ in range(rng.randint(3, 6))) for _ in range(150)})
        got = sorted(tuple(sorted((words[a], words[b]))) for a, b in spelling.search(words, words))
        assert got == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near_by_hand(a, b)]


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert spelling.op12(df).count() == 0 and spelling.op12(df.limit(0)).count() == 0


# SentencePiece

ODD = [
    None, "", " ", "a", "  a b ", "a\x00b", "▁x", "x▁▁ y", "日本 語 \U0001f600", "a\n\tb", "<s>hi</s><0x41><unk>", "é é", "﻿x",
    " " * 1000, "a" * 5000, "\U0001f600" * 30, "\x00" * 3, "\r\n\r\n  ", "\n" * 100, "  \n  \n", "x" * 40 + "ab" * 9000, "same", "same",
]


@pytest.fixture(scope="module")
def piece_model():
    return tokenizer("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab e'st\n.!1é日▁<>0x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_prefix_table_equals_library(text):
    model = pieces.model(tokenizer("piece_bpe_32k.model"))
    ids = list(memoryview(model.encode(text)).cast("i"))
    assert ids == model.library.encode(text) and model.decode(ids) == model.library.decode(ids)


def test_pieces_end_to_end_equal_library(piece_model):
    model, rng = pieces.model(piece_model), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(model.names[3:]) for _ in range(rng.randint(1, 12)))
        ids = list(memoryview(model.encode(text)).cast("i"))
        assert ids == model.library.encode(text) and model.decode(ids) == model.library.decode(ids)


def test_piece_rows(spark, piece_model):
    lib = SentencePieceProcessor(model_file=piece_model)
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(df, piece_model, ["doc_id"]), piece_model).collect()
    want = [(i if i else None, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t in enumerate(ODD)]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    for r in pieces.op13(df, piece_model).collect():
        ids = lib.encode(ODD[r.doc_id or 0] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert pieces.op13(df.limit(0), piece_model).count() == 0

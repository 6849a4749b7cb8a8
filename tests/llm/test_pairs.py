"""SimHash, embeddings and repeats against brute force; hot groups, ties, nulls and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from prevuelo.llm import neighbours, repeats, simhash
from prevuelo.llm.graph import components
from prevuelo.llm.gsaca import suffix_array

DOCS = "doc_id long, text string, kept string"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    links += [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2080)] + [(5, 5), (7, 9), (9, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, links)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > n)


def test_fingerprints():
    for text in [None, "", " \t\n", "a", "A b", "a b c d", "a b c d a b c d e", "É é\x85x \x0b y Z", "x " * 5000]:
        assert simhash.fingerprint(text) == fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=4), st.integers(0, 2**64 - 1))
def test_close_fingerprints_share_a_cell(bits, fp):
    other = fp
    for b in bits:
        other ^= 1 << b
    mine, theirs = (set(simhash.cells(np.array([x], np.uint64))[0].tolist()) for x in (fp, other))
    assert mine & theirs


def test_simhash_groups(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.randint(1, 5)):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append(" ".join(edited))
    rows += [None, "", " ", "same text here"] + ["same text here"] * 30
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    data = [*zip(ids, rows, ["x"] * len(rows)), (None, "same text here", "x"), (None, "a lone text without an id", "x"), (None, "a lone text without an id", "x")]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    fps = {i: fingerprint(t) for i, t, _ in data if i is not None}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(fps, links)
    got = simhash.op9(df).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert len(set(want.values())) < len(fps)
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert [r.text for r in kept if r.doc_id is None] == ["a lone text without an id"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "kept"}
    assert simhash.op9(df.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    """No group may vanish because its id occurs in another group too."""
    rng = random.Random(12)
    a, b, c, z, y = (" ".join(f"{k}{rng.randint(0, 999)}" for _ in range(60)) for k in "abczy")
    rows = [(5, a, 1), (5, c, 1), (5, c, 1), (6, b, 1), (6, z, 1), (2, b, 1), (7, None, 1), (7, "", 1), (None, y, 1), (None, a, 1), (8, y, 1), (8, z, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _key int").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(5, a), (5, c), (2, b), (6, z), (7, ""), (8, y)])
    # links join the first two here: of the rows with the smallest id, the first by text stays
    near = a.split()
    for i in range(60):
        other = " ".join([*near[:i], "q", *near[i + 1 :]])
        if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(other)).bit_count() <= 4:
            break
    else:
        other = a + " "
    two = spark.createDataFrame([(5, a, 1), (5, other, 1), (None, a, 1)], df.schema)
    assert [(r.doc_id, r.text) for r in simhash.keep_one(two).collect()] == [(5, min(a, other))]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_full_cells_are_divided(monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 5)
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(80)})
    arr = np.array(fps, np.uint64)
    found = simhash.close_pairs(np.zeros(len(fps), np.int64), arr, 4)
    got = {tuple(sorted((int(i), int(j)))) for a, b in found for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed(texts):
    """Brute force on bytes: (n_bytes, n_removed, n_spans, digest) by row."""
    size = repeats.LENGTH
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[a : a + size] for t in raw for a in range(len(t) - size + 1))
    out = []
    for t in raw:
        cover, end = bytearray(len(t)), 0
        for a in range(len(t) - size + 1):
            if seen[t[a : a + size]] > 1:
                cover[max(a, end) : a + size] = b"\1" * (a + size - max(a, end))
                end = a + size
        kept = bytes(c for x, c in zip(cover, t) if not x)
        spans = sum(1 for k, x in enumerate(cover) if x and (k == 0 or not cover[k - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 350, 900, 60, 120)]
    line = text(130)
    rows = [None, "", "short", text(200), text(5000), "a" * 700, "ab" * 400]
    for _ in range(60):
        rows.append("".join(rng.choice([text(rng.randint(0, 150)), rng.choice(shared), line]) for _ in range(rng.randint(1, 6))))
    return rows + [rows[3], rows[9], rows[9]] + [text(90) + line + text(90) for _ in range(40)]


@pytest.mark.parametrize("most", [2_000, 10])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    texts = passages(most)
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = removed(texts)
    for r in repeats.op2(df).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id or 0], r.doc_id
    whole = repeats.dedup(df, characters=True)
    assert whole.columns == ["doc_id", "kept", "kept_", "n_bytes", "n_removed", "n_spans"]
    assert repeats.op2(df.limit(0)).count() == 0


def test_repeats_frequent_paths(spark, monkeypatch):
    """The sample marks stretches and anchors; no result may change by that."""
    monkeypatch.setattr(repeats, "SHARE", 1.0)
    monkeypatch.setattr(repeats, "SEEN", 6)
    texts = passages(4) + [passages(4)[9]] * 10
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = removed(texts)
    for r in repeats.op2(df).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 700)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    which, anchor, content, start, more, place = repeats.stretches([b"", text, text[:199], text])
    assert set(which.tolist()) == {1, 3}
    covered = sorted(s for w, s0, m in zip(which, start, more) if w == 1 for s in range(s0, s0 + m + 1))
    assert covered == list(range(len(text) - 199))


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((base * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.35])).tolist())
    return rows


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(vectors(5))]
    n = len(rows)
    rows += [(n + k, rows[1][1], 1) for k in range(25)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], rows[1][1][:8]]
    rows += [(n + k, v, 1) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    good = {i: (np.array(v), c) for i, v, c in rows[:n] if c is not None}
    links = []
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i < j and x == y and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links.append((i, j))
    want = roots([r[0] for r in rows], links)
    count = Counter(i for pair in links for i in pair)
    got = neighbours.op7(df).collect()
    assert len(got) == len(rows) and len(links) > 300
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], c, c == i) for i, c in want.items()}
    assert neighbours.op7(df.limit(0)).count() == 0


def test_collisions_are_counted():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, neighbours.PROJECTIONS)), rng.normal(size=(50, neighbours.PROJECTIONS))
    got = neighbours.collisions(a, b, 0.4)
    want = (np.abs(a[:, None] - b[None]) <= 0.4).sum(2)
    assert np.abs(got.astype(int) - want).max() <= 1

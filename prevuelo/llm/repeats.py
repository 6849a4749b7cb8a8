"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else are removed.

1. Anchors. Each string of LENGTH bytes is filed under its anchor, the 50-byte gram in it with the smallest hash. Equal
   strings have equal anchors at equal places, so only strings of one anchor need be compared. Neighbouring strings with
   the same anchor occurrence form a stretch of up to 350 bytes; a task turns texts into stretches with numpy and sends
   hashes and places only.
2. Copies. Stretches with equal anchor and equal content are repeated as a whole and need no bytes. What is left of an
   anchor with different stretches are candidates; their bytes are cut out of the texts.
3. Suffix arrays. Candidates are cut into blocks of 25 bytes, counted from the anchor, and the suffix array of all blocks of
   a chunk is built by linear grouping (``gsaca``). Suffixes that share seven blocks (175 bytes) stand together; the
   remaining 25 bytes, left and right of them, decide which strings of LENGTH bytes are equal.
4. An anchor with more than ``MOST`` different stretches (a common line between other texts) goes another exact way: its
   stretches are cut into runs of ``WIDE`` strings, at places counted from the anchor. A run that is found again is
   repeated as a whole; one whose common bytes are not found again holds no repeat; any other is halved and counted
   again, down to single strings. So a stretch keeps about one run per edge of what it shares, and pairs never become rows.

Skew. Stretches that a small sample shows to be frequent are marked where they are found and never sent; anchors that it
shows to be frequent are dealt by content as well. The sample steers the dealing only, never a result.

A null text counts as empty. Strings are judged on the input; matches do not cross documents. Repeated rows are documents
of their own, so all of their strings are repeated. Equality rests on 128 bits of hashes or on the bytes. Extra columns
are kept whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from prevuelo.llm.gsaca import suffix_array
from prevuelo.llm.store import free, prepare, written

LENGTH, GRAM, BLOCK = 200, 50, 25
WINDOW = LENGTH - GRAM + 1
#: Different stretches of an anchor that are compared in one task.
MOST = 2_000
#: Strings of a run at first, a power of two below LENGTH.
WIDE = 64
#: Bytes that numpy works on at once; blocks in one suffix array.
PART, CHUNK = 1 << 18, 30_000
#: Share of documents that is looked at for skew, how often a sampled stretch or anchor must be seen, how many are noted.
SHARE, SEEN, NOTED = 0.02, 24, 10_000

_M = np.uint64
_BASES = (_M(0x9E3779B97F4A7C15), _M(0xC2B2AE3D27D4EB4F))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses modulo 2^64."""
    inverse = _M(pow(int(base), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (base, inverse))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Hashes:
    """Polynomial hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        if which not in _TABLES or len(_TABLES[which][0]) < len(data) + 1:
            _TABLES[which] = _powers(_BASES[which], max(len(data), PART + 4096))
        power, self.inverse = _TABLES[which]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _M(1)) * power[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        with np.errstate(over="ignore"):
            return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> _M(32))
        x = x * _M(0xD6E8FEB86659FD93)
        return x ^ (x >> _M(32))


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, content hash, start, last start - start, anchor - start) of each stretch."""
    found = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        # a long text is worked on in parts that share all but one byte of a string
        for at in range(0, max(1, len(t) - LENGTH + 1), PART):
            part = t[at : at + PART + LENGTH - 1]
            if len(part) >= LENGTH:
                group.append((k, at, part))
                size += len(part)
            if size >= PART:
                found.append(_stretches(group))
                group, size = [], 0
    if group:
        found.append(_stretches(group))
    if not found:
        return tuple(np.empty(0, d) for d in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretches(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join([p for _, _, p in group]), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = Hashes(data, 0)
    grams = first.grams(GRAM)
    # the smallest hash of each window, the leftmost of equal ones: the place is in the low bits
    low = _M((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = WINDOW - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & low).astype(np.int64)  # by the start of the string
    breaks = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    cuts = np.unique(np.concatenate([breaks, starts, ends - LENGTH + 1]))
    cuts = cuts[cuts < len(anchor)]
    which = np.searchsorted(ends, cuts, "right")
    last = np.append(cuts[1:] - 1, len(anchor) - 1)
    valid = cuts <= ends[which] - LENGTH
    cuts, which, last = cuts[valid], which[valid], last[valid]
    last = np.minimum(last, ends[which] - LENGTH)
    texts = np.array([k for k, _, _ in group])[which]
    offsets = np.array([a for _, a, _ in group])[which] - starts[which]
    place = anchor[cuts]
    content = Hashes(data, 1).of(cuts, last + LENGTH)
    return texts, grams[place], content, cuts + offsets, last - cuts, place - cuts


def equal_strings(chunk: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """(stretch, first, last): runs of starts of strings that another stretch of the same anchor holds too.

    ``chunk`` has (anchor number, bytes, last start, anchor's place) of different stretches.
    """
    data = np.frombuffer(bytes(BLOCK) + b"".join([b + bytes(BLOCK) for _, b, _, _ in chunk]), np.uint8)
    sizes = np.array([len(b) for _, b, _, _ in chunk])
    base = BLOCK + np.cumsum(sizes + BLOCK) - sizes - BLOCK
    phase = np.array([o for _, _, _, o in chunk]) % BLOCK
    blocks = (sizes - phase) // BLOCK
    owner = np.repeat(np.arange(len(chunk)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = base[owner] + phase[owner] + BLOCK * nth
    rows = np.empty((len(owner), 8 + 4 + BLOCK), np.uint8)
    rows[:, :8] = np.array([a for a, _, _, _ in chunk], ">u8")[owner].view(np.uint8).reshape(-1, 8)
    # a block's place counted from the anchor is part of it: equal strings have it in common
    place = nth - (np.array([o for _, _, _, o in chunk]) // BLOCK)[owner] + 1_000
    rows[:, 8:12] = place.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 12:] = data[at[:, None] + np.arange(BLOCK)]
    _, symbols = np.unique(rows.view([("", f"V{rows.shape[1]}")]).ravel(), return_inverse=True)
    # one text: the blocks of each stretch, then a symbol of its own
    text_at = np.arange(len(owner)) + owner
    text = np.full(len(owner) + len(chunk), -1, np.int64)
    text[text_at] = symbols
    gaps = np.flatnonzero(text < 0)
    text[gaps] = symbols.max(initial=-1) + 1 + np.arange(len(gaps))
    order = np.array(suffix_array(text.tolist()))
    block_of = np.full(len(text), -1, np.int64)
    block_of[text_at] = np.arange(len(owner))
    need = LENGTH // BLOCK - 1
    padded = np.concatenate([text, -1 - np.arange(need)])
    seven = padded[order[:, None] + np.arange(need)]
    same = np.concatenate([[False], (seven[1:] == seven[:-1]).all(1)])
    kind = np.cumsum(~same)
    shared = same | np.append(same[1:], False)
    member = block_of[order[shared]]
    kind = kind[shared]
    kind, member = kind[member >= 0], member[member >= 0]
    if not len(member):
        return []
    # 25 bytes before the seven blocks and 25 after them
    around = data[at[member][:, None] + np.concatenate([np.arange(-BLOCK, 0), need * BLOCK + np.arange(BLOCK)])]
    start = at[member] - base[owner[member]]
    last = np.array([x for _, _, x, _ in chunk])[owner[member]]
    hits = []
    for left in range(BLOCK):
        first = start - left
        ok = np.flatnonzero((first >= 0) & (first <= last))
        if len(ok) < 2:
            continue
        mine = np.empty((len(ok), 8 + BLOCK), np.uint8)
        mine[:, :8] = kind[ok].astype("<u8").view(np.uint8).reshape(-1, 8)
        mine[:, 8:] = around[ok, BLOCK - left : 2 * BLOCK - left]
        _, back, count = np.unique(mine.view([("", f"V{mine.shape[1]}")]).ravel(), return_inverse=True, return_counts=True)
        again = ok[count[back] > 1]
        hits.append(np.stack([owner[member[again]], first[again]], 1))
    if not hits:
        return []
    hits = np.unique(np.concatenate(hits), axis=0)
    new = np.concatenate([[True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hits)) - 1
    return list(zip(hits[begin, 0].tolist(), hits[begin, 1].tolist(), hits[end, 1].tolist()))


# A stretch's place in one long: start, last start - start, anchor - start; then two marks for dealing.
_KNOWN, _HOT = 1 << 61, 1 << 60


def _place(start: np.ndarray, more: np.ndarray, place: np.ndarray) -> np.ndarray:
    return start << 16 | more << 8 | place


def _placed(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (pos & ((1 << 60) - 1)) >> 16, (pos >> 8) & 255, pos & 255


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


_OCCURRENCE = "anchor long, content long, id long, k long, pos long"
_JUDGED = "id long, k long, anchor long, pos long, repeated boolean, candidate boolean"
_STRING = "anchor long, id long, k long, start long, more long, place long, bytes binary"
_SPAN = "id long, k long, first long, last long, rel long, bytes binary"


def occurrences(texts: DataFrame, known: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Stretches of the texts (id, k, text), marked where they are known repeats or have a hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, anchor, content, start, more, place = stretches([t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()])
            pos = _place(start, more, place)
            signed = anchor.view(np.int64)
            if len(known):
                pos = pos | np.where(np.isin(anchor ^ mixed(content), known), _KNOWN, 0)
            if len(hot):
                pos = pos | np.where(np.isin(signed, hot), _HOT, 0)
            pick = pa.array(which, pa.int64())
            yield _batch(_OCCURRENCE, signed, content.view(np.int64), b.column(0).take(pick), b.column(1).take(pick), pa.array(pos, pa.int64()))

    return texts.select("id", "k", "text").mapInArrow(run, _OCCURRENCE)


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """From the sample: marks of frequent stretches, hot anchors, those of many different stretches, one row of each mark."""
    none = np.empty(0, np.int64)
    seen = written(occurrences(texts.sample(SHARE, 5), none, none), "sampled")
    whole = seen.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "k", "pos")).alias("one"))
    whole = whole.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "anchor", "content").limit(NOTED).collect()
    anchors = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.countDistinct("content").alias("different"))
    anchors = anchors.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "anchor").limit(NOTED).collect()
    a, c = (np.array([r[x] for r in whole], np.int64).view(np.uint64) for x in ("anchor", "content"))
    ones = [(r["one"]["id"], r["one"]["k"], r["anchor"], r["one"]["pos"], False, True) for r in whole]
    hot = np.union1d(np.array([r["anchor"] for r in anchors], np.int64), a.view(np.int64))
    wide = np.array([r["anchor"] for r in anchors if r["different"] >= SEEN], np.int64)
    return a ^ mixed(c), hot, wide, ones


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the run of each element of sorted ``keys``."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(at, len(keys)))
    return np.repeat(at, sizes), np.repeat(sizes, sizes)


def judged(found: DataFrame) -> DataFrame:
    """Of the occurrences the whole repeats, and the candidates: one of each content under an anchor with several.

    A hot anchor is spread by content, so all its contents are candidates. Known repeats are spread by place; one of each
    is a candidate elsewhere.
    """

    def judge(t: pa.Table, before: tuple, after: tuple) -> pa.RecordBatch:
        anchor, content, pos = (t[c].to_numpy() for c in ("anchor", "content", "pos"))
        known, n = (pos & _KNOWN) != 0, len(anchor)
        same = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        above = np.concatenate([[before == (anchor[0], content[0])], same])
        below = np.append(same, after == (anchor[-1], content[-1]))
        at, size = _runs(anchor)
        various = (content[at] != content[at + size - 1]) | ((pos & _HOT) != 0)
        # the anchor goes on in the batch before or after: with another content, or one of several
        various |= (at == 0) & (before[0] == anchor[0])
        various |= (at + size == n) & (after[0] == anchor[-1])
        repeated, candidate = above | below | known, various & ~above & ~known
        use = repeated | candidate
        t = t.filter(pa.array(use))
        cells = [t[c].combine_chunks() for c in ("id", "k", "anchor", "pos")]
        return _batch(_JUDGED, *cells, repeated[use], candidate[use])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, (None, None)
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                if held is not None:
                    yield judge(held, before, (t["anchor"][0].as_py(), t["content"][0].as_py()))
                    before = (held["anchor"][-1].as_py(), held["content"][-1].as_py())
                held = t
        if held is not None:
            yield judge(held, before, (None, None))

    pos = F.col("pos")
    spread = F.when(pos.bitwiseAND(F.lit(_KNOWN)) != 0, F.xxhash64("id", "pos")).when(pos.bitwiseAND(F.lit(_HOT)) != 0, F.col("content")).otherwise(0)
    return found.repartition("anchor", spread).sortWithinPartitions("anchor", "content").mapInArrow(run, _JUDGED)


def _in_runs(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The stretches' strings in runs of ``WIDE`` by their place from the anchor."""
    out = []
    for r in rows:
        at = 0
        while at <= r["more"]:
            rel = at - r["place"]
            last = min(r["more"], at + WIDE - 1 - rel % WIDE)
            out.append((r["id"], r["k"], r["start"] + at, r["start"] + last, rel, r["bytes"][at : last + LENGTH]))
            at = last + 1
    kinds = [pa.int64()] * 5 + [pa.binary()]
    cells = list(zip(*out)) or [[]] * 6
    yield _batch(_SPAN, *(pa.array(list(c), k) for c, k in zip(cells, kinds)))


def halved(runs: DataFrame) -> list[DataFrame]:
    """(id, k, first, last) of the repeated strings among runs of up to ``WIDE`` of them; each round is stored."""
    whole, size = [], WIDE
    while True:
        # what all strings have that begin in the run's part of the grid, whether the run fills the part or not
        core = f"substring(bytes, CAST({size} - pmod(rel, {size}) AS INT), {LENGTH + 1 - size})"
        hashes = [f"xxhash64({seed}, {text}) AS {name}{seed}" for name, text in (("h", "bytes"), ("c", core)) for seed in (1, 2)]
        runs = written(runs.selectExpr("*", *hashes), "runs")
        if runs.isEmpty():
            return whole
        cores = written(runs.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "cores")
        again = written(runs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "again")
        alive = written(runs.join(cores, ["c1", "c2"]).join(again, ["h1", "h2"], "left"), "alive")
        whole.append(alive.where("n IS NOT NULL").select("id", "k", "first", "last"))
        if size == 1:
            return whole
        size //= 2
        # where the next half begins, if it is in the run
        cut = f"first + {size} - pmod(rel, {size})"
        one = "named_struct('a', first, 'b', least(last, cut - 1))"
        parts = f"IF(cut <= last, array({one}, named_struct('a', cut, 'b', last)), array({one}))"
        # one of equal runs goes on, for what other runs share with a part of it
        rest = alive.where("n IS NULL").unionByName(alive.where("n IS NOT NULL").dropDuplicates(["h1", "h2"])).selectExpr("id", "k", "first", "rel", "bytes", "last", f"{cut} AS cut")
        rest = rest.selectExpr("id", "k", "first AS old", "rel AS old_rel", "bytes AS old_bytes", f"inline({parts})")
        runs = rest.selectExpr(
            "id", "k", "a AS first", "b AS last", "old_rel + a - old AS rel",
            f"substring(old_bytes, CAST(a - old + 1 AS INT), CAST(b - a + {LENGTH} AS INT)) AS bytes",
        )


def compared(strings: DataFrame, wide: np.ndarray) -> DataFrame:
    """(id, k, first, last): runs of starts of repeated strings; with ``bytes``: runs still to be counted."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _in_runs(b.to_pylist())

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if rows:
            runs = equal_strings([(r["anchor"] & (2**64 - 1), r["bytes"], r["more"], r["place"]) for r in rows])
            cells = list(zip(*[(rows[i]["id"], rows[i]["k"], rows[i]["start"] + a, rows[i]["start"] + z) for i, a, z in runs])) or [[]] * 4
            yield _batch(_SPAN, *(pa.array(list(c), pa.int64()) for c in cells), pa.nulls(len(runs), pa.int64()), pa.nulls(len(runs), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[dict] = []  # rows of complete anchors
        own: list[dict] = []  # rows of the anchor being read
        blocks, anchor, over = 0, None, False
        for b in batches:
            for r in b.to_pylist():
                if r["anchor"] != anchor:
                    if over:
                        yield from _in_runs(own)
                    elif len(own) > 1:
                        whole += own
                        blocks += sum([len(x["bytes"]) // BLOCK + 1 for x in own])
                    own, anchor, over = [], r["anchor"], False
                    if blocks >= CHUNK:
                        yield from solve(whole)
                        whole, blocks = [], 0
                own.append(r)
                over = over or len(own) > MOST
                if over and len(own) >= 500:
                    yield from _in_runs(own)
                    own = []
        if over:
            yield from _in_runs(own)
        elif len(own) > 1:
            whole += own
        yield from solve(whole)

    far = F.col("anchor").isin([int(a) for a in wide]) if len(wide) else F.lit(False)
    near = strings.where(~far).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPAN)
    return near.unionByName(strings.where(far).mapInArrow(singles, _SPAN)) if len(wide) else near


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of half-open spans, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[new, 0], ends[np.append(new[1:], len(spans)) - 1]], 1)


def without(text: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def dedup(df: DataFrame, text: str = "text", digest: bool = False, characters: bool = False) -> DataFrame:
    """All columns but the text, and kept (binary), n_bytes, n_removed, n_spans; new names get ``_`` where they clash.

    With ``digest`` kept is the SHA-256 of the remaining bytes, so finished texts are not stored meanwhile. With
    ``characters`` the rest of a character that a cut has divided goes too, so what remains is text.
    """
    from hashlib import sha256

    prepare(df.sparkSession)
    keep = [c for c in df.columns if c != text]
    body, own_id, own_k, facts = (free(df, c) for c in ("kept", "_id", "_k", "_facts"))
    counts = [free(df, c) for c in ("n_bytes", "n_removed", "n_spans")]

    def shape(kept: bytes) -> bytes:
        kept = kept.decode("utf-8", "ignore").encode() if characters else kept
        return sha256(kept).digest() if digest else kept

    whole = F.coalesce(F.col(text), F.lit(""))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")) if "doc_id" in df.columns else F.lit(-1).cast("long")
    texts = df.select(ids.alias("id"), F.xxhash64(whole).alias("k"), whole.alias("text"))
    known, hot, wide, ones = frequent(texts)
    facts_of = judged(occurrences(texts, known, hot))
    if ones:
        facts_of = facts_of.unionByName(df.sparkSession.createDataFrame(ones, _JUDGED))
    # bounded by the length of one text; equal rows of known repeats are one
    each = facts_of.groupBy("id", "k", "anchor", "pos").agg(F.max("repeated").alias("repeated"), F.max("candidate").alias("candidate"))
    info = each.groupBy("id", "k").agg(F.collect_list(F.struct("anchor", "pos", "repeated", "candidate")).alias(facts))
    base = df.select(*keep, ids.alias(own_id), F.xxhash64(whole).alias(own_k), whole.alias(body))
    full = base.join(info, (F.col(own_id) == F.col("id")) & (F.col(own_k) == F.col("k")), "left").drop("id", "k")
    n = len(keep)
    kept_fields = [df.schema[c] for c in keep]
    count_fields = [StructField(c, LongType()) for c in counts]
    state = StructType(
        [*kept_fields, StructField(own_id, LongType()), StructField(own_k, LongType()), StructField(body, BinaryType()), *count_fields]
        + [StructField("_spans_", BinaryType()), StructField("_cands_", BinaryType())]
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column(n + 2).to_pylist(), b.column(n + 3)):
                raw = t.encode("utf-8", "surrogatepass")
                if not found.is_valid:
                    out.append((shape(raw), len(raw), 0, 0, None, None))
                    continue
                cells = found.values
                pos = cells.field("pos").to_numpy()
                start, more, place = _placed(pos)
                again = cells.field("repeated").to_numpy(zero_copy_only=False)
                cand = cells.field("candidate").to_numpy(zero_copy_only=False)
                spans = merged(np.stack([start[again], start[again] + more[again] + LENGTH], 1))
                if not cand.any():
                    kept = without(raw, spans)
                    out.append((shape(kept), len(raw), len(raw) - len(kept), len(spans), None, None))
                else:
                    packed = np.stack([cells.field("anchor").to_numpy()[cand], start[cand], more[cand], place[cand]], 1)
                    out.append((raw, len(raw), 0, 0, spans.astype("<i8").tobytes(), packed.astype("<i8").tobytes()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            cells = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 2], *(pa.array(list(c), k) for c, k in zip(cells, kinds))], state.fieldNames())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, k, raw, packed in zip(*(b.column(i).to_pylist() for i in range(4))):
                anchor, start, more, place = np.frombuffer(packed, "<i8").reshape(-1, 4).T
                parts = [raw[a : a + m + LENGTH] for a, m in zip(start.tolist(), more.tolist())]
                m = len(parts)
                yield _batch(_STRING, anchor, pa.array([own] * m, pa.int64()), pa.array([k] * m, pa.int64()), start, more, place, pa.array(parts, pa.binary()))

    done = StructType([*kept_fields, StructField(body, BinaryType()), *count_fields])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, packed, more in zip(b.column(n + 2).to_pylist(), b.column(n + 6).to_pylist(), b.column(n + 8)):
                spans = np.frombuffer(packed, "<i8").reshape(-1, 2)
                if more.is_valid:
                    cells = more.values
                    spans = np.concatenate([spans, np.stack([cells.field("first").to_numpy(), cells.field("last").to_numpy() + LENGTH], 1)])
                spans = merged(spans)
                kept = without(raw, spans)
                out.append((shape(kept), len(raw), len(raw) - len(kept), len(spans)))
            cells = list(zip(*out)) or [[]] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(list(c), k) for c, k in zip(cells, kinds))], done.fieldNames())

    table = written(full.mapInArrow(first, state), "repeats")
    pending = table.where("_cands_ IS NOT NULL")
    strings = pending.select(own_id, own_k, body, "_cands_").mapInArrow(cut, _STRING)
    found = written(compared(strings, wide), "compared")
    spans = found.where("bytes IS NULL").select("id", "k", "first", "last")
    for more in halved(found.where("bytes IS NOT NULL")):
        spans = spans.unionByName(more)
    spans = spans.groupBy("id", "k").agg(F.collect_list(F.struct("first", "last")).alias("_more_"))
    joined = pending.join(spans, (F.col(own_id) == F.col("id")) & (F.col(own_k) == F.col("k")), "left").drop("id", "k")
    finished = table.where("_cands_ IS NULL").select(*done.fieldNames())
    return finished.unionByName(joined.mapInArrow(second, done))


def op2(df: DataFrame) -> DataFrame:
    found = dedup(df.select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))

"""BPE encoding by tree concatenation, and decoding, for byte-level vocabularies.

Texts up to ``LEAF`` characters are encoded where they lie. A longer text is cut into leaves, which are rows of their
own, so executors encode the parts of one text in parallel. Where the split pattern of the vocabulary has a border, a
cut there is exact and the ids are simply laid end to end. A stretch that the pattern leaves unsplit for more than
``LEAF`` characters is cut into pieces at any byte, and neighbours are joined in a tree: a window around the join grows
until its own ids begin with the left side's id and end with the right side's id. Ids of unsplit text are its encoding
exactly if each adjacent pair of ids is the encoding of the pair's bytes; all pairs of the joined ids lie in the left
ids, in the window or in the right ids, so agreement on one id on either side makes the joined ids exact.

Null texts count as empty and have no ids. Rows may repeat and stay apart; columns other than ``keep`` and the text are
not read, so their names cannot clash. An empty table gives an empty result. A document's ids end up in one row, as its
text began in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from prevuelo.llm.store import prepare
from prevuelo.llm.tokens import Encoder, encoder, ids_of

#: Characters of a leaf.
LEAF = 16_384

#: Pieces that an encoding worker remembers; a decoding one stands beside it, so fewer than elsewhere.
PIECES = 120_000

#: Kinds of leaves: ordinary text, a special token, the first and the further pieces of unsplit text.
TEXT, SPECIAL, FIRST, NEXT = range(4)

_BLANK = regex.compile(r"(?<=\S) (?=\S)")


def leaves(enc: Encoder, text: str, leaf: int = LEAF) -> Iterator[tuple[int, str]]:
    """(kind, text) of each leaf; the texts concatenate to ``text``."""
    special = "|".join(map(regex.escape, enc.special))
    for part in regex.split(f"({special})", text) if special else [text]:
        if part in enc.special:
            yield SPECIAL, part
        elif part:
            yield from _stretches(enc, part, leaf)


def _stretches(enc: Encoder, text: str, leaf: int) -> Iterator[tuple[int, str]]:
    at = 0
    while len(text) - at > leaf:
        blank = _BLANK.search(text, at + max(1, leaf // 2))
        end = blank.start() if blank else len(text)
        if end - at <= 2 * leaf:
            yield TEXT, text[at:end]
        else:
            yield from _unblanked(enc, text[at:end], leaf)
        at = end
    if at < len(text):
        yield TEXT, text[at:]


def _unblanked(enc: Encoder, text: str, leaf: int) -> Iterator[tuple[int, str]]:
    """Leaves of a stretch that begins and ends at borders of the split pattern."""
    held, size = [], 0
    for _, (a, b) in enc.tokenizer.pre_tokenizer.pre_tokenize_str(text):
        if b - a > leaf:
            # white space before it was split with a view to it: those pieces stay as they are
            white = len(held)
            while white and held[white - 1][-1].isspace():
                white -= 1
            if white:
                yield TEXT, "".join(held[:white])
            yield from ((FIRST, piece) for piece in held[white:])
            held, size = [], 0
            for i in range(a, b, leaf):
                yield (FIRST if i == a else NEXT), text[i : min(b, i + leaf)]
            continue
        # white space at a leaf's end would be split otherwise than before the next character
        if size >= leaf and not held[-1][-1].isspace():
            yield TEXT, "".join(held)
            held, size = [], 0
        held.append(text[a:b])
        size += b - a
    if held:
        yield TEXT, "".join(held)


def join(left: list[int], right: list[int], merge: Callable[[bytes], list[int]], pieces: list[bytes]) -> list[int]:
    """Ids of unsplit text from the ids of its two sides."""
    size = 4
    while True:
        a, b = min(size, len(left)), min(size, len(right))
        window = merge(b"".join([pieces[i] for i in left[len(left) - a :] + right[:b]]))
        left_done = a == len(left) or window[0] == left[-a]
        right_done = b == len(right) or window[-1] == right[b - 1]
        if left_done and right_done:
            return left[: len(left) - a] + window + right[b:]
        size *= 2


def concatenate(parts: list[list[int]], merge: Callable[[bytes], list[int]], pieces: list[bytes]) -> list[int]:
    """The join of neighbours, then of neighbouring pairs, and so on."""
    while len(parts) > 1:
        pairs = [join(a, b, merge, pieces) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[2 * len(pairs) :]
    return parts[0]


def encode_leaf(enc: Encoder, kind: int, text: str) -> bytes:
    if kind == TEXT:
        return enc.encode([text])[0]
    if kind == SPECIAL:
        return enc.whole([text])[0]
    return _raw(enc.merge(text.encode()))


def assemble(enc: Encoder, kinds: list[int], ids: list[bytes]) -> bytes:
    """Ids of a text from the ids of its leaves in order."""
    out: list[bytes] = []
    run: list[list[int]] = []

    def close() -> None:
        if run:
            out.append(_raw(concatenate(run.copy(), enc.merge, enc.token_bytes)))
            run.clear()

    for kind, raw in zip(kinds, ids):
        if kind != NEXT:
            close()
        if kind in (FIRST, NEXT):
            run.append(ids_of(raw).tolist())
        else:
            out.append(raw)
    close()
    return b"".join(out)


def _raw(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode(df: DataFrame, tokenizer: str, keep: list[str], text: str = "text", ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``keep`` columns and ``ids``: a binary of little-endian unsigned 32-bit ids."""
    prepare(df.sparkSession)
    kept = [df.schema[k] for k in keep]
    done = StructType([*kept, StructField(ids, BinaryType())])
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = len(keep)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = encoder(tokenizer, PIECES).encode(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.binary())], [*keep, ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(leaves(encoder(tokenizer, PIECES), b.column(n)[i].as_py(), leaf))
                same = b.slice(i, 1).take(pa.array([0] * len(found)))
                cells = [pa.array(range(len(found)), pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*same.columns[:n], same.column(n + 1), *cells], [*keep, "_row", "_leaf", "_kind", "_text"])

    def leafwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(tokenizer, PIECES)
            found = [encode_leaf(enc, k, t) for k, t in zip(b.column(n + 2).to_pylist(), b.column(n + 3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 3], pa.array(found, pa.binary())], [*keep, "_row", "_leaf", "_kind", ids])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("_leaf")
        raw = assemble(encoder(tokenizer, PIECES), table["_kind"].to_pylist(), table[ids].to_pylist())
        return table.slice(0, 1).select(keep).append_column(ids, pa.array([raw], pa.binary()))

    is_long = F.length("_text") > leaf
    place = [StructField("_row", LongType()), StructField("_leaf", IntegerType()), StructField("_kind", IntegerType())]
    parts = rows.where(is_long).withColumn("_row", F.monotonically_increasing_id())
    parts = parts.mapInArrow(cut, StructType([*kept, *place, StructField("_text", StringType())]))
    parts = parts.repartition("_row", "_leaf").mapInArrow(leafwise, StructType([*kept, *place, StructField(ids, BinaryType())]))
    return rows.where(~is_long).mapInArrow(short, done).unionByName(parts.groupBy("_row").applyInArrow(whole, done))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``text``: the text of ``ids``, special tokens kept; a null stays null."""
    prepare(df.sparkSession)
    out = StructType([*df.schema.fields, StructField(text, StringType())])
    at = df.columns.index(ids)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(tokenizer, PIECES)
            found = [None if r is None else enc.decode(ids_of(r)) for r in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], out.fieldNames())

    return df.mapInArrow(texts, out)


def op1(df: DataFrame, tokenizer: str) -> DataFrame:
    decoded = decode(encode(df, tokenizer, ["doc_id"]), tokenizer)
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

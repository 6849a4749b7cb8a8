"""Fill-in-the-middle by piece tables.

A document is a row of descriptors (buffer, start, stop) over two buffers that never change: the UTF-8 bytes of its text
and the sentinels. Cutting splits a descriptor in two, an arrangement permutes the descriptors with sentinels put between
them, and digests run over the bytes that the descriptors name, one after the other, so no text is copied until the
transformed text itself is written. Restoring reads the transformed text: it is one descriptor, cut around its
sentinels, put back by the inverse permutation.

Which texts are transformed, where they are cut and how the parts are arranged follows from a keyed hash of the id, so
any run on any cluster gives the same result.

Null texts count as empty and stay as they are (form ``plain``), as do texts that hold a sentinel. A null id is hashed as
no digits. Rows may repeat and stay rows; columns other than ``keep``, the id and the text are not read, so their names
cannot clash. Empty tables give empty results. Every text is one row from the scan to the result, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from prevuelo.llm.store import free, prepare

# The sentinels, and the order of the parts of each form (0 prefix, 1 middle, 2 suffix).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, MIDDLE, SUFFIX)
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

#: Buffers of a table: its text, and the sentinels end to end.
TEXT, MARKS = 0, 1
_MARKS = b"".join(SENTINELS)

#: Bytes that are looked through at a time.
_BLOCK = 1 << 20


@dataclass
class PieceTable:
    """Descriptors (buffer, start, stop) over immutable buffers."""

    text: memoryview
    pieces: list[tuple[int, int, int]]

    @classmethod
    def of(cls, text: memoryview) -> PieceTable:
        return cls(text, [(TEXT, 0, len(text))])

    def cut(self, *places: int) -> PieceTable:
        """Descriptors split at bytes of the table's whole content; a cut at an end leaves an empty piece."""
        out, at, left = [], 0, sorted(places)
        for n, (buffer, start, stop) in enumerate(self.pieces):
            end = at + stop - start
            while left and (left[0] < end or (left[0] == end and n == len(self.pieces) - 1)):
                middle = start + left.pop(0) - at
                out.append((buffer, start, middle))
                at, start = at + middle - start, middle
            out.append((buffer, start, stop))
            at = end
        return PieceTable(self.text, out)

    def arrange(self, order: tuple[int, ...]) -> PieceTable:
        """The pieces in the given order, each behind the sentinel of its kind."""
        mark = [(MARKS, 3 * k, 3 * k + 3) for k in range(len(SENTINELS))]
        return PieceTable(self.text, [d for k in order for d in (mark[k], self.pieces[k])])

    def restore(self, order: tuple[int, ...]) -> PieceTable:
        """The inverse: pieces of a transformed text without its sentinels, in their first order."""
        raw = self.text
        found = [0, *(_find(raw, SENTINELS[k], 3) for k in order[1:])]
        table = self.cut(*[x for at in found for x in (at, at + 3)])
        # an empty piece, then sentinel and part by turns
        parts = table.pieces[2::2]
        back = sorted(range(len(order)), key=order.__getitem__)
        return PieceTable(raw, [parts[i] for i in back])

    def __iter__(self) -> Iterator[memoryview]:
        marks = memoryview(_MARKS)
        for buffer, start, stop in self.pieces:
            yield (marks if buffer == MARKS else self.text)[start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self:
            digest.update(part)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self)


def _find(raw: memoryview, mark: bytes, start: int = 0) -> int:
    """Place of the first ``mark`` from ``start`` on, -1 if there is none; blocks overlap by the mark's length."""
    for at in range(start, len(raw), _BLOCK):
        found = bytes(raw[at : at + _BLOCK + len(mark) - 1]).find(mark)
        if found >= 0:
            return at + found
    return -1


def _blocks(raw: memoryview) -> Iterator[np.ndarray]:
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, len(whole), _BLOCK):
        yield whole[at : at + _BLOCK]


def count_lines(raw: memoryview) -> int:
    return sum(int((b == 10).sum()) for b in _blocks(raw)) + (len(raw) > 0 and raw[-1] != 10)


def line_ends(raw: memoryview, wanted: list[int]) -> list[int]:
    """Where the first ``k`` lines end, for ascending ``k``."""
    out, before, at, left = [], 0, 0, list(wanted)
    while left and left[0] == 0:
        out.append(left.pop(0))
    for block in _blocks(raw):
        ends = np.flatnonzero(block == 10)
        while left and left[0] <= before + len(ends):
            out.append(at + int(ends[left.pop(0) - before - 1]) + 1)
        if not left:
            break
        before, at = before + len(ends), at + len(block)
    return out + [len(raw)] * len(left)


def characters(raw: memoryview) -> int:
    """Code points of UTF-8."""
    return sum(int(((b & 0xC0) != 0x80).sum()) for b in _blocks(raw))


def draws(doc_id: int | None, key: str) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


@dataclass(frozen=True)
class Made:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    table: PieceTable


def transformed(raw: memoryview, doc_id: int | None, key: str, rate: int, spm: int) -> Made:
    table, n = PieceTable.of(raw), count_lines(raw)
    h = draws(doc_id, key)
    if not len(raw) or h[2] % 100 >= rate or any(_find(raw, s) >= 0 for s in SENTINELS):
        return Made(n, "plain", None, None, table)
    ends = line_ends(raw, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = table.cut(*ends)
    prefix, middle = characters(raw[: ends[0]]), characters(raw[ends[0] : ends[1]])
    return Made(n, form, prefix, middle, parts.arrange(ORDERS[form]))


def _views(column: pa.Array) -> list[memoryview]:
    """The bytes of each text where they lie; a null is empty."""
    return [memoryview(c.as_buffer()) if c.is_valid else memoryview(b"") for c in column]


def _buffers(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def transform(
    df: DataFrame,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    key: str = "7",
    rate: int = 100,
    spm: int = 50,
    output: str = "output",
) -> DataFrame:
    """``keep`` columns, n, form, prefix_chars, middle_chars, the transformed text and its ``{output}_sha256``.

    ``rate`` percent of the texts are transformed, of these ``spm`` percent with the suffix in front.
    """
    prepare(df.sparkSession)
    n = len(keep)
    fields = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType())]
    fields += [(output, StringType()), (f"{output}_sha256", StringType())]
    out = StructType([*[df.schema[k] for k in keep], *[StructField(name, kind) for name, kind in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _views(_buffers(b.column(n + 1)))
            made = [transformed(t, i, key, rate, spm) for i, t in zip(b.column(n).to_pylist(), texts)]
            cells = [
                pa.array([m.n for m in made], pa.int64()),
                pa.array([m.form for m in made], pa.string()),
                pa.array([m.prefix_chars for m in made], pa.int64()),
                pa.array([m.middle_chars for m in made], pa.int64()),
                pa.array([m.table.bytes() for m in made], pa.binary()).view(pa.string()),
                pa.array([m.table.sha256() for m in made], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cells], out.fieldNames())

    at, body = free(df, "_id"), free(df, "_text")
    return df.select(*keep, F.col(doc_id).cast("long").alias(at), F.col(text).alias(body)).mapInArrow(run, out)


def restore(df: DataFrame, keep: list[str], output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """``keep`` columns, the text that a transformed one was made of, and its ``{text}_sha256``."""
    prepare(df.sparkSession)
    n = len(keep)
    out = StructType([*[df.schema[k] for k in keep], StructField(text, StringType()), StructField(f"{text}_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [
                PieceTable.of(t).restore(ORDERS[f]) if f in ORDERS else PieceTable.of(t)
                for f, t in zip(b.column(n).to_pylist(), _views(_buffers(b.column(n + 1))))
            ]
            cells = [pa.array([t.bytes() for t in tables], pa.binary()).view(pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cells], out.fieldNames())

    shape, body = free(df, "_form"), free(df, "_output")
    return df.select(*keep, F.col(form).alias(shape), F.col(output).alias(body)).mapInArrow(run, out)


def op11(df: DataFrame) -> DataFrame:
    found = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    made = restore(transform(df, ["doc_id"]), found, text="restored")
    return made.select(*found, "restored_sha256")

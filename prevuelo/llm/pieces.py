"""SentencePiece BPE encoding by a prefix table, and decoding.

The encoding of a text has one encoding of each of its prefixes that ends at a token border inside it, and adjacent
tokens are right together exactly if the two are the encoding of their own concatenation: merges go by score, then from
the left, and leaving out what stands before or behind does not change the order of those that remain. So each prefix of
a text has one last token: of the pieces that end there (an automaton names them all in one pass), the one that is
compatible with the last token of the prefix before it. The table of last tokens is filled from left to right, in time
proportional to the text, and the ids are read from it backwards. A pair is tested by
the merges at its border, once per worker; pieces that merging never makes are left out.

A character that is no piece is a token of its own, merges with nothing, and is written as the ids of its bytes. Where no
piece of the model goes on into a blank, a blank begins a new unit and each different unit is encoded once per worker.

Null texts count as empty and have no ids. Rows may repeat and stay apart; columns other than ``keep`` and the text are
not read, so their names cannot clash. An empty table gives an empty result. A text of any length is encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from prevuelo.llm.store import free, prepare

#: Different units, and different pairs of tokens, that a worker remembers.
MAX_UNITS, MAX_PAIRS = 200_000, 800_000

#: Characters of a unit that is worth remembering.
_SHORT = 48

_BLANK = "▁"


class Model:
    """The pieces of a model file and the tables to encode and decode with them."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        if any(lib.is_unused(i) for i in range(n)) or lib.Normalize("Åﬁ a  b ") != f"{_BLANK}Åﬁ{_BLANK}a{_BLANK}{_BLANK}b{_BLANK}":
            raise ValueError("models with unused pieces or their own normalisation of texts are not supported")
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.byte_ids):
            raise ValueError("models without byte pieces are not supported")
        self.names = names
        # the better a piece's score, the earlier it is merged; equal scores go by place alone
        self.rank = {names[i]: -lib.get_score(i) for i in range(n) if i not in special}
        self.ids = {names[i]: i for i in range(n) if i not in special}
        self.found = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if len(name) == 1 or self.merged(name) == [name]:
                self.found.add_word(name, (len(name), i))
        self.found.make_automaton()
        inner = any(_BLANK in name.lstrip(_BLANK) for name in self.ids)
        # no piece joins a line end to anything: it is a unit
        line = "" if any("\n" in name and len(name) > 1 for name in self.ids) else "\n"
        units = ".+" if inner else f"{_BLANK}*[^{_BLANK}{line}]+|{_BLANK}+|\n"
        self.units = regex.compile(units, regex.DOTALL).findall
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.known: dict[str, bytes] = {}
        # what each id adds to a decoded text
        self.parts = [b"" if i in special else names[i].replace(_BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.parts[i] = bytes([b])

    def merged(self, text: str, history: list[tuple[float, str, str]] | None = None) -> list[str]:
        """A short text's tokens by merging: of all neighbours that make a piece the best, of equal ones the leftmost.

        ``history`` gets the rank of each merge and the first and last part behind it.
        """
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if history is not None:
                history.append((best, parts[0], parts[-1]))

    def _edges(self, token: int) -> tuple[list[float], list[str], list[str]]:
        """The ranks of a token's own merges in order, ended by infinity, and its first and last part before each."""
        known = self.edges.get(token)
        if known is None:
            name, history = self.names[token], []
            self.merged(name, history)
            known = [r for r, _, _ in history] + [inf], [name[0], *(x for _, x, _ in history)], [name[-1], *(x for _, _, x in history)]
            self.edges[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """The two tokens are the encoding of their concatenation: while each is merged as it is alone, the best or
        leftmost of both first, the parts at the border never come first."""
        (mine, _, lasts), (theirs, firsts, _) = self._edges(left), self._edges(right)
        rank, i, j = self.rank, 0, 0
        while True:
            across, x, y = rank.get(lasts[i] + firsts[j], inf), mine[i], theirs[j]
            if across < x and across <= y:
                return False
            if x is inf and y is inf:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def last_tokens(self, unit: str) -> list[int]:
        """The last token of each prefix, -1 behind a character that is no piece."""
        last = [-1] * len(unit)
        pairs, settled = self.pairs, -1
        for end, (length, token) in self.found.iter(unit):
            if end == settled:  # only one of the tokens that end here is right
                continue
            before = end - length
            # the character without a piece merges with nothing, nor does the beginning
            if before >= 0 and last[before] >= 0:
                key = last[before] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = self.compatible(last[before], token)
                    if len(pairs) < MAX_PAIRS:
                        pairs[key] = fits
                if not fits:
                    continue
            last[end], settled = token, end
        return last

    def encode_unit(self, unit: str) -> bytes:
        """Ids of a unit as native 32-bit integers, read backwards from its table."""
        last, end = self.last_tokens(unit), len(unit) - 1
        ids = array("i")
        while end >= 0:
            token = last[end]
            if token < 0:
                ids.extend(self.byte_ids[b] for b in reversed(unit[end].encode("utf-8", "surrogatepass")))
                end -= 1
            else:
                ids.append(token)
                end -= len(self.names[token])
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, out = self.known, []
        for unit in self.units(_BLANK + text.replace(" ", _BLANK)):
            ids = known.get(unit)
            if ids is None:
                ids = self.encode_unit(unit)
                if len(unit) <= _SHORT and len(known) < MAX_UNITS:
                    known[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's; what is no UTF-8 goes to the library."""
        parts = self.parts
        raw = b"".join([parts[i] for i in ids])
        # one blank before the first piece was put there by the encoder
        if ids and raw[:1] == b" " and self.names[ids[0]][:1] == _BLANK:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode(ids)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The worker's model of a file; the file must lie at the same path on every machine."""
    return Model(path)


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``ids``, an array of integers."""
    prepare(df.sparkSession)
    n = len(keep)
    out = StructType([*[df.schema[k] for k in keep], StructField(ids, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [model(path).encode(t) for t in b.column(n).to_pylist()]
            ends = np.cumsum([0, *[len(r) // 4 for r in raw]], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(raw), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.ListArray.from_arrays(pa.array(ends), values)], [*keep, ids])

    return df.select(*keep, F.col(text).alias(free(df, "_text"))).mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``text``: the text of ``ids``; a null stays null."""
    prepare(df.sparkSession)
    out = StructType([*df.schema.fields, StructField(text, StringType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = (b.column(at)[i].values for i in range(b.num_rows))
            found = [None if c is None else model(path).decode(c.to_numpy(zero_copy_only=False).tolist()) for c in cells]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], out.fieldNames())

    return df.mapInArrow(run, out)


def op13(df: DataFrame, path: str) -> DataFrame:
    decoded = decode(encode(df, path, ["doc_id"]), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

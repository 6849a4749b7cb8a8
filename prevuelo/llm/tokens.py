"""Helper inside tasks: ids of whole texts from a tokenizers file, as little-endian unsigned 32-bit bytes.

The ids are the library's own. What is saved is repeated work: a text is cut at blanks between two visible characters,
where neither supported split pattern can match across, and each different piece is encoded once per worker. Texts for
which that is not certain (characters beyond Latin-1, control characters, double blanks, special tokens) go to the
library whole.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property, lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Different pieces that a worker remembers; about 200 bytes each.
MAX_PIECES = 200_000

_PLAIN = bytes([9, 10, *range(32, 127), *range(161, 256)])


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where visible, else from U+0100 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


_STAND_INS = dict(enumerate(_byte_chars()))

#: Fixed value: the split of byte-level vocabularies without a pattern of their own.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Pieces(dict):
    """Ids by piece; an unknown piece is split and looked up word by word, and remembered while there is room."""

    def __init__(self, find, lead: str, model, most: int):
        super().__init__()
        self.find, self.lead, self.tokenize, self.most = find, lead, model.tokenize, most
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        words, parts = self.words, []
        for w in self.find(self.lead + piece):
            ids = words.get(w)
            if ids is None:
                ids = array("I", [t.id for t in self.tokenize(w.encode().decode("latin-1").translate(_STAND_INS))]).tobytes()
                if len(words) < self.most:
                    words[w] = ids
            parts.append(ids)
        ids = b"".join(parts)
        if len(self) < self.most:
            self[piece] = ids
        return ids


def _state(part) -> dict:
    return json.loads(part.__getstate__()) if part is not None else {}


class Encoder:
    def __init__(self, path: str, most: int = MAX_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the parts' own states; the whole file would be read a second time, with all its merges
        pre, normalizer = _state(self.tokenizer.pre_tokenizer), _state(self.tokenizer.normalizer)
        steps = pre.get("pretokenizers", [])
        normal = [n["type"] for n in normalizer.get("normalizers", [])]
        # blanks lead the next word / blanks are dropped and letters lowered / neither: always the library
        self.leads = pre.get("type") == "ByteLevel" and pre["use_regex"] and not normalizer and not pre["add_prefix_space"]
        self.drops = bool(steps) and steps[0].get("behavior") == "Removed" and normal == ["NFC", "Replace", "Lowercase"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.leads or self.drops:
            pattern = _WORDS if self.leads else steps[0]["pattern"]["Regex"]
            find = regex.compile(pattern).findall
            self.pieces = _Pieces(find, " " if self.leads else "", self.tokenizer.model, most)
            self.heads = _Pieces(find, "", self.tokenizer.model, most // 4)  # pieces that begin a text

    def _cut(self, text: str) -> list[str] | None:
        """The text's pieces, or None where only the whole text will do."""
        try:
            odd = text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return None
        if odd or any(s in text for s in self.special):
            return None
        if self.drops:
            return text.lower().split()
        if not self.leads or "  " in text or "\n " in text or " \n" in text or "\t" in text:
            return None
        return text.split(" ")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes that the split pattern leaves in one piece."""
        return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(_STAND_INS))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        cut = self._cut(text)
        if cut is None:
            return self.whole([text])[0]
        if self.leads:
            head = self.heads[cut.pop(0)]
            return head + b"".join(map(self.pieces.__getitem__, cut))
        return b"".join(map(self.pieces.__getitem__, cut))

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """Bytes of each id of a byte-level vocabulary."""
        back = {c: b for b, c in enumerate(_byte_chars())}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [bytes(back.get(c, 0) for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with special tokens kept; bytes that are no UTF-8 go to the library."""
        table = self.token_bytes
        try:
            return b"".join([table[i] for i in ids.tolist()]).decode("utf-8")
        except (UnicodeDecodeError, IndexError):
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str, most: int = MAX_PIECES) -> Encoder:
    """The worker's encoder for a file; the file must lie at the same path on every machine."""
    return Encoder(path, most)


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")

"""Token ids of texts inside tasks, equal to those of the tokenizers library.

A word-level BPE splits a text into pieces that are encoded one by one, so ids are looked up piece by
piece and the library's model is asked once per new piece.  This way in is open to texts made of plain
characters only (ASCII, Latin letters with marks in composed form), where the library's normalizer does
nothing but lower the case and its splitting rule is a short pattern; and it is open only to a
tokenizer file that names exactly that normalizer and rule.  Everything else goes through the
library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# The splitting rule of the tokenizer file this shortcut knows.
KNOWN_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
KNOWN_STEPS = ["NFC", "Replace", "Lowercase"]

_PLAIN = re.compile("[\\x20-\\x7e\\t\\n\\rÀ-ÖØ-öø-įı-ž]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-z0-9ß-öø-ž]+")
#: Pieces remembered per Python worker; beyond it the memory is emptied.
REMEMBERED_PIECES = 300_000


class _Pieces(dict):
    """The ids of pieces, worked out by the library's model when a piece is first met."""

    def __init__(self, library):
        super().__init__()
        self._model = library.model
        self._spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        self._spelled: dict[str, str] = {}

    def __missing__(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([self._spell(c) for c in piece])
        ids = array("I", [token.id for token in self._model.tokenize(spelled)]).tobytes()
        self[piece] = ids
        return ids

    def _spell(self, char: str) -> str:
        """A character as the model spells its bytes; plain texts have a few hundred different ones."""
        if char not in self._spelled:
            self._spelled[char] = self._spelling.pre_tokenize_str(char)[0][0]
        return self._spelled[char]


class Encoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self._known = (
            [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])] == KNOWN_STEPS
            and [s.get("type") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
            == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": KNOWN_RULE}
        )
        self._pieces = _Pieces(self.library)

    def by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts) -> list[bytes]:
        """The ids of each text, in order."""
        out, known = [], self._pieces
        for text in texts:
            if self._is_plain(text):
                out.append(b"".join([known[p] for p in _PIECES.findall(text.lower())]))
                if len(known) > REMEMBERED_PIECES:
                    known.clear()
            else:
                out.append(self.by_library(text))
        return out

    def _is_plain(self, text: str) -> bool:
        return self._known and bool(_PLAIN.fullmatch(text)) and not any(s in text for s in self._special)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)

    @property
    def byte_lengths(self) -> np.ndarray:
        """For every id the bytes of normalized text, without white space, that it covers."""
        return _byte_lengths(self)


@lru_cache(maxsize=2)
def _byte_lengths(encoder: Encoder) -> np.ndarray:
    lengths = np.zeros(encoder.size, dtype=np.int64)
    suffix = encoder.library.model.end_of_word_suffix or ""
    for token, at in encoder.library.get_vocab(with_added_tokens=True).items():
        lengths[at] = len(token.removesuffix(suffix) if suffix and token not in encoder._special else token)
    return lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)

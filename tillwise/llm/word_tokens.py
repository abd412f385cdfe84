"""Ids of a word-level BPE tokenizer, word by word with a bounded cache.

The tokenizer's pre-tokens never cross white space, so a text's ids are its words' ids one after the other. Words of
plain letters, digits and marks are normalised and cut here and merged by the tokenizer's own model; anything else
(special tokens, letters with unusual case rules, odd white space) goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import struct
import unicodedata

import regex
from tokenizers import Tokenizer

#: Words a worker remembers before it starts afresh.
CACHED_WORDS = 1_000_000

# The tokenizer's own pre-token pattern.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Letters whose lower case depends on the context, or changes their number of characters.
ODD_CASE = frozenset("ΣİǅǈǋǲǄǇǊǱ")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Maps a word's UTF-8 bytes to its ids, packed as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_file(path)
        self._merge = self._whole.model.tokenize
        self._alphabet = byte_alphabet()

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if not ODD_CASE.isdisjoint(text):
                return self._whole.encode(text, add_special_tokens=False).ids
        if "<|" in text:
            return self._whole.encode(text, add_special_tokens=False).ids
        text = text.lower()
        if text.isascii() and text.isprintable():
            parts = [text] if text.isalpha() else PRE_TOKENS.findall(text)
        else:
            alphabet = self._alphabet
            parts = ["".join([alphabet[b] for b in p.encode("utf-8")]) for p in PRE_TOKENS.findall(text)]
        return [token.id for part in parts for token in self._merge(part)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = packed
        return packed

    def text_ids(self, text: bytes) -> bytes:
        """Packed ids of a whole text; ``bytes.split`` cuts at exactly the six ASCII white-space bytes."""
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One instance per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]

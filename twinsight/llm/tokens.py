"""Token ids of many texts with a file of the tokenizers library.

Byte-pair encoding works on one pre-token at a time, so a text's ids are the ids of its pre-tokens in a row. Texts
whose characters all lie below U+0250, also once they are normalised, are split here, and a pre-token that was not seen
lately goes once through the library's model; any other text, or one with a special token's string in it, goes through
the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

#: Below this code point, letters and numbers are the same in every Unicode version in use.
PLAIN_BELOW = 0x250
#: Bytes of pre-tokens and their ids that one Python worker keeps, with EACH for an entry's objects. When they are full
#: they become the former ones, which are looked up too, and the ones before those go.
KEEP_BYTES, EACH = 32 << 20, 200
#: Longer pre-tokens are not kept.
LONGEST = 64

_CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
_LETTERS = "".join(re.escape(chr(i)) for i in range(PLAIN_BELOW) if unicodedata.category(chr(i))[0] == "L")
_NUMBERS = "".join(re.escape(chr(i)) for i in range(PLAIN_BELOW) if unicodedata.category(chr(i))[0] == "N")
_LEADING_SPACE = re.compile(rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_SPACELESS = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Not plain: code points from PLAIN_BELOW on, and separators that engines disagree about.
_ODD = re.compile(r"[\x1c-\x1f\x85ɐ-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _folded(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


class Encoder(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; encode() does whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.held, self.former = 0, {}
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        kinds = [s and s["type"] for s in steps]
        normalizers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not spec["normalizer"]:
            self.normal, self.split = str, _LEADING_SPACE.findall
        elif kinds == ["Split", "ByteLevel"] and not steps[1]["use_regex"] and normalizers == ["NFC", "Replace", "Lowercase"]:
            self.normal, self.split = _folded, _SPACELESS.findall
        else:
            self.normal, self.split = str, None
        self.letters = _byte_letters()
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = self.former.get(piece)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        if len(piece) <= LONGEST:
            self.held += len(piece) + len(ids) + EACH
            if self.held > KEEP_BYTES:
                self.former = dict(self)
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        """The library's own way, for any text."""
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or _ODD.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        shown = self.normal(text)
        # Capitals below PLAIN_BELOW can have their small letter above it.
        if shown is not text and not shown.isascii() and _ODD.search(shown):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(shown)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

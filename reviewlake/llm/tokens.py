"""Token ids as the ``tokenizers`` library gives them, with a memory of words.

Byte-pair merges never cross the pieces into which a tokenizer first cuts its text, so a text may
be encoded word by word wherever a cut is certain:

* byte-level BPE: before a blank or a line feed that stands between two characters that aren't
  white space, and between a letter and a following ``.``, ``,`` or the like;
* BPE with word ends: at blanks and line feeds, which it drops, and in the same second place.

Each word is encoded by the library once and remembered per worker process (800 000 words of at
most 64 characters). A text that
has other white space at such a place, or the string of an added token, is encoded whole; so is
every text under a tokenizer of another make. The ids are those of ``Tokenizer.encode`` on the
whole text either way; tests hold both against each other.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array

MAX_WORDS = 800_000
MAX_LENGTH = 64  #: of a remembered word, so that the number of words bounds the bytes too
_STEM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?%$&*#|;:]*)\Z")
_ENCODERS: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the settings under which it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added|no truncation").hexdigest()


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1
    characters stand for themselves, the others for U+0100 and following in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """word -> its ids as little-endian 32-bit bytes; None: the text around it must be whole."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        ids = self.make(word)
        if len(word) <= MAX_LENGTH:
            self[word] = ids
        return ids


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """``encode(texts)`` gives each text's ids as bytes (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.kind = self._kind(spec)
        self.letters = byte_letters()
        self.first = _Words(lambda w: self._word("", w))
        self.words = _Words(self._piece)
        self.signs = _Words(self._ids)  # what follows a run of letters

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or spec.get("added_tokens") and any(
                t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [n.get("type") for n in (norm or {}).get("normalizers", ())]
        split = [p.get("type") for p in pre.get("pretokenizers", ())]
        if steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and model.get("end_of_word_suffix"):
            return "word"
        return "whole"

    def _ids(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stem(self, blank: str, stem: str) -> bytes:
        """A run of Latin letters goes to the BPE model as it is: no rule would cut it."""
        if self.kind != "byte":
            blank, stem = "", stem.lower()
        if not stem.isascii():  # ASCII letters stand for themselves
            stem = "".join([self.letters[b] for b in stem.encode()])
        shown = self.letters[ord(blank)] + stem if blank else stem
        return as_bytes([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _word(self, blank: str, word: str) -> bytes | None:
        """Ids of a word after ``blank`` ('' or ' '); None if white space at its edges joins what
        stands beside it."""
        if not word:
            return b"" if self.kind == "word" else None
        if m := _STEM.match(word):
            if not m[2]:
                return self._stem(blank, word)
            stem = self.words[m[1]] if blank and self.kind == "byte" or self.kind == "word" else self._stem(blank, m[1])
            return stem + self.signs[m[2]]
        if self.kind == "byte" and (word[0].isspace() or word[-1].isspace()):
            return None
        return self._ids(blank + word)

    def _piece(self, piece: str) -> bytes | None:
        if self.kind == "byte" and piece[:1] == "\n":
            rest = self._word("", piece[1:])
            return None if rest is None else self._ids("\n") + rest
        return self._word(" " if self.kind == "byte" else "", piece)

    def _one(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or any(a in text for a in self.added):
            return self._ids(text)
        if self.kind == "word":
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.replace("\n", " \n").split(" ")
        ids = [self.first[head], *map(self.words.__getitem__, rest)]
        return self._ids(text) if None in ids else b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(self._one(text))
            if len(self.words) + len(self.first) + len(self.signs) > MAX_WORDS:
                self.words.clear()
                self.first.clear()
                self.signs.clear()
        return out


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file, made on first use."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

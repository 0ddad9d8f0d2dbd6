"""Tokenising whole texts inside tasks, with a memory of the parts they consist of."""

from __future__ import annotations

import os
import re
import struct

import regex

# Unicode white space, at which both kinds of pre-tokenizer break.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORD = re.compile(f"[^{WHITE}]+")

# Characters that lower-casing and normalisation leave in their place, one for one.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORD_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
# The byte tokenizer's own pattern, and what it comes to in texts of these characters alone, where plain ``re`` is faster.
_BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_EASY_PARTS = re.compile(
    " ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+"
)

_LOADED: dict[str, PartTokenizer] = {}


def byte_letters() -> str:
    """The visible character of each byte in vocabularies of byte-level tokenizers: itself, or for those without one, the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """Ids (bytes) by part, found when first asked for; of two generations the older goes when the younger is full."""

    def __init__(self, find: object, room: int) -> None:
        super().__init__()
        self.find, self.room, self.older = find, room, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.find(part)
        self[part] = ids
        return ids

    def age(self) -> None:
        """Called between texts, so a text never loses what it has just found."""
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()


class PartTokenizer:
    """Ids of whole texts, equal to the tokenizer's own, found part by part.

    Parts are what the tokenizer itself breaks texts into before it merges anything, so the
    ids of a text are those of its parts in a row, and the tokenizer's model is asked once for a part
    that comes again and again. Two generations of ``room`` parts are kept, about 50 MB
    each. White-space chunks with other characters than plain ones (word tokenizer) go to the
    tokenizer whole, and so does a text that holds one of its special strings.
    """

    def __init__(self, path: str, room: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None  # the word tokenizer drops white space; the byte tokenizer keeps it
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_special = re.compile("|".join(map(re.escape, self.special)))
        self.letters = byte_letters()
        self.parts = Memory(self._part, room)
        self.chunks = Memory(self._whole, room // 8)

    def _part(self, part: str) -> bytes:
        easy = part.isascii() and part.isprintable()
        shown = part.replace(" ", self.letters[32]) if easy else part.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(shown)])

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return b"".join(map(self.parts.__getitem__, _WORD_PARTS.findall(chunk.lower())))
        return self.chunks[chunk]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of one text; null has none."""
        if not text:
            return b""
        if self.any_special.search(text):
            return self._whole(text)
        self.parts.age()
        self.chunks.age()
        plain = _PLAIN.fullmatch(text)
        if self.lowers:
            if not plain:
                return b"".join(map(self._chunk, _WORD.findall(text)))
            parts = _WORD_PARTS.findall(text.lower())
        else:
            parts = _EASY_PARTS.findall(text) if plain else _BYTE_PARTS.findall(text)
        return b"".join(map(self.parts.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.ids, texts))


def tokenizer(path: str) -> PartTokenizer:
    """One for each path and Python worker, as workers serve many tasks."""
    if path not in _LOADED:
        _LOADED[path] = PartTokenizer(path)
    return _LOADED[path]

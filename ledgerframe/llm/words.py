"""Splitting text into the pieces that a lower-casing word-end BPE works on.

The tokenizer file's front end is: special strings are cut out; the rest is put
in NFC, lower-cased, and split by ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|`` and
runs of other non-space characters; white space is dropped.  A piece's ids do not
depend on its neighbours, so ids are remembered by piece.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import weakref
from collections.abc import Callable

#: Unicode's White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Characters that the library looks at in one call, to learn its classes.
BLOCK = 4096


@functools.cache
def _ranges(prop: str) -> str:
    """A character class body: what the library's own expressions hold to have the property.

    The characters go to the library in blocks, and runs that touch are joined: for all of
    them at once it takes some 270 MB for a moment, in each Python worker.
    """
    from tokenizers import Regex, pre_tokenizers

    finder, runs = pre_tokenizers.Split(Regex(rf"\p{{{prop}}}+"), "removed", invert=True), []
    for at in range(0, sys.maxunicode + 1, BLOCK):
        block = "".join(chr(i) for i in range(at, min(at + BLOCK, sys.maxunicode + 1)) if not 0xD800 <= i < 0xE000)
        for run, _ in finder.pre_tokenize_str(block):
            first, last = ord(run[0]), ord(run[-1])
            if runs and runs[-1][1] + 1 == first:
                first = runs.pop()[0]
            runs.append((first, last))
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def _pattern(letter: str, number: str, white: str) -> re.Pattern[str]:
    # the alternatives start with different characters, so their order is free but for the last two
    return re.compile(f"[{letter}]+|[{number}]|'(?:[stmd]|re|ve|ll)|[^{white}{letter}{number}]+")


@functools.cache
def piece_pattern() -> re.Pattern[str]:
    return _pattern(_ranges("L"), _ranges("N"), re.escape(WHITE))


@functools.cache
def latin_pattern() -> re.Pattern[str]:
    """The same for texts within Latin-1, whose classes fit a bit map."""
    letter, number = (f"[{_ranges(p)}]" for p in "LN")
    latin = [chr(i) for i in range(256)]
    of = lambda c: re.escape("".join(x for x in latin if re.match(c, x)))
    return _pattern(of(letter), of(number), re.escape("".join(x for x in WHITE if x < "\u0100")))


def split(low: str) -> list[str]:
    """Pieces of a normalised text."""
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return piece_pattern().findall(low)
    return latin_pattern().findall(low)


def normalise(text: str) -> str:
    """NFC, then each character's own lower case (no final-sigma rule)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def pieces(text: str) -> list[str]:
    """Pieces of a text that holds no special string."""
    return split(normalise(text))


class Memo(dict):
    """piece -> value in two generations of at most ``size`` pieces each.

    A full generation becomes the old one; pieces still in use move on.  Memory
    is bounded whatever the vocabulary of the corpus.  A Python worker outlives its
    tasks and serves one operator after another: a memo that learns empties the one
    that learned before, so a worker holds one at most.
    """

    learning = staticmethod(lambda: None)

    def __init__(self, make: Callable[[str], object], size: int = 200_000) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, piece: str) -> object:
        if (other := Memo.learning()) is not self:
            if other is not None:
                other.forget()
            Memo.learning = weakref.ref(self)
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class LibraryEncoder:
    """The tokenizers library, run once for each piece instead of each occurrence.

    ``ids(text)`` equals ``encode(text, add_special_tokens=False).ids`` as
    little-endian unsigned 32-bit integers.  Texts that hold a special string, or
    whose lower-cased form is not in NFC, go to the library whole.
    """

    def __init__(self, path: str, memo: int = 200_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import array

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._array = array.array
        self.model = self.tokenizer.model
        self.memo = Memo(self._piece, memo)

    def _piece(self, piece: str) -> bytes:
        # letters a to z pass the file's front end as they are, in one piece: the library's model alone gives the same
        if piece.isascii() and piece.isalpha() and piece.islower():
            return self._bytes([t.id for t in self.model.tokenize(piece)])
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, numbers: list[int]) -> bytes:
        ids = self._array("I", numbers)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        low = normalise(text)
        if any(s in text for s in self.specials) or not unicodedata.is_normalized("NFC", low):
            return self._whole(text)
        return b"".join(map(self.memo.__getitem__, split(low)))


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    """One per Python worker."""
    return LibraryEncoder(path)

"""Operator 3: BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding keeps a window of symbols.  The merge list itself says how far a later
symbol can reach back (``sufficient_lookahead``); tokens that end at least so far
before the window's end can no longer change and are emitted, the window moves
on, and memory stays constant however long a piece is.

Why the bound holds.  Run the merges on a text and on a longer text, in rank
order.  Up to some boundary ``p`` both runs have the same tokens; at first ``p`` is
the end of the shorter text.  A merge inside the agreed part happens in both.  So
``p`` moves only when one run merges ``u|v`` across it: then ``u`` ends at ``p``, and
``p`` moves left by ``len(u)``.  ``v`` starts where the last such merge started, so
one of ``v`` and that merge's result is a prefix of the other, and its rank is
lower.  The longest such chain, weighted by ``len(u)``, is the bound.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, functions as F

from .words import WHITE, Memo, normalise, pieces, split

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[tuple[int, ...], tuple[int, ...]]]) -> int:
    """Symbols after a token's end that fix it, for merges (u, v) in rank order as symbol tuples."""
    exact: dict[tuple[int, ...], int] = {}  # merge result -> longest reach
    below: dict[tuple[int, ...], int] = {}  # proper prefix of a merge result -> longest reach
    most = 0
    for u, v in merges:
        reach = len(v) - 1  # it may be the first of a chain, across the text's end
        for k in range(1, len(v) + 1):
            reach = max(reach, exact.get(v[:k], 0))
        reach = len(u) + max(reach, below.get(v, 0))
        m = u + v
        exact[m] = max(exact.get(m, 0), reach)
        for k in range(1, len(m)):
            if below.get(m[:k], 0) < reach:
                below[m[:k]] = reach
        most = max(most, reach)
    return most


class Transducer:
    """Encoder and decoder for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str, window: int | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.alphabet = byte_alphabet()
        self.symbol = [vocab[c] for c in self.alphabet]
        self.last = [vocab[c + self.suffix] for c in self.alphabet] if self.suffix else self.symbol
        spelled: dict[int, tuple[int, ...]] = {i: (i,) for i in {*self.symbol, *self.last}}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        listed = []
        for rank, (a, b) in enumerate(pairs):
            left, right = vocab[a], vocab[b]
            made = vocab[a + b]
            listed.append((spelled[left], spelled[right]))  # a KeyError here: a rule uses a token made later
            spelled.setdefault(made, spelled[left] + spelled[right])
            self.merge.setdefault((left, right), (rank, made))
        self.length = {i: len(s) for i, s in spelled.items()}
        self.lookahead = sufficient_lookahead(listed)
        self.window = max(window or 4 * self.lookahead, self.lookahead + max(self.length.values()) + 1)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}

    def _merged(self, ids: list[int]) -> list[int]:
        """All merges on a window: always the lowest rank, of equal ones the leftmost."""
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        get, none = self.merge.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long windows, in n log n steps."""
        n, get = len(ids), self.merge.get
        ids, after, prior = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                prior[after[k]] = k
            for x in (prior[k], k):
                if x >= 0 and (y := after[x]) < n and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece whose UTF-8 bytes come in chunks; holds at most a window and a chunk."""
        held: list[int] = []
        before: int | None = None  # the last byte is a symbol of its own kind, so one byte waits
        for chunk in data:
            for b in chunk:
                if before is not None:
                    held.append(self.symbol[before])
                    if len(held) >= self.window:
                        held = yield from self._stable(held)
                before = b
        if before is not None:
            held.append(self.last[before])
            yield from self._merged(held)

    def _stable(self, held: list[int]):
        """Emit what can no longer change; what is left is symbols again."""
        safe, at = len(held) - self.lookahead, 0
        for i in self._merged(list(held)):
            if at + self.length[i] > safe:
                break
            at += self.length[i]
            yield i
        return held[at:]

    def encode_piece(self, piece: str) -> list[int]:
        return list(self.stream([piece.encode("utf-8")]))

    @functools.cached_property
    def _specials(self):
        import re

        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id, "") for a special string, (None, text) for what lies between."""
        for k, part in enumerate(self._specials.split(text) if self._specials else [text]):
            if k % 2:
                yield self.special[part], ""
            elif part:
                yield None, part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in self.segments(text):
            if i is not None:
                out.append(i)
            else:
                for piece in pieces(part):
                    out += self.encode_piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does for a file without decoder: token strings joined by one space."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def decode_text(self, ids: Iterable[int]) -> str:
        """The (lower-cased) text: bytes through the state machine, a space at each word's end."""
        machine = self.text_machine()
        return machine(ids) + machine(None)

    def text_machine(self):
        """A function that takes ids as they come and gives the text that is certain; at None, the rest."""
        machine = ByteToText()

        def feed(ids: Iterable[int] | None) -> str:
            if ids is None:
                return machine.end()
            out = []
            for i in ids:
                token = self.token[i]
                if token in self.special:
                    out += [machine.end(), token, " "]
                    continue
                end = bool(self.suffix) and token.endswith(self.suffix)
                body = token[: -len(self.suffix)] if end else token
                out.append(machine.feed(bytes(self.byte_of[c] for c in body)))
                if end:
                    out += [machine.end(), " "]
            return "".join(out)

        return feed


class ByteToText:
    """UTF-8 bytes to text, a few at a time.

    State: bytes still expected, the value so far, and the range the next byte
    must lie in (which rules out overlong forms and surrogates).  A broken
    sequence gives one U+FFFD, and the byte that broke it is looked at afresh.
    """

    def __init__(self) -> None:
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.need, self.value, self.low, self.high = self.need - 1, self.value << 6 | b & 0x3F, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                self.need = 0
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xE0:
                self.need, self.value, self.low, self.high = 1, b & 0x1F, 0x80, 0xBF
            elif 0xE0 <= b < 0xF0:
                self.need, self.value, self.low, self.high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b < 0xF5:
                self.need, self.value, self.low, self.high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence becomes."""
        cut, self.need = self.need, 0
        return "�" if cut else ""


@functools.cache
def transducer(path: str) -> Transducer:
    """One per Python worker."""
    return Transducer(path)


def chunks(text: str, size: int = 1 << 16) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end after white space, so no piece is cut."""
    at, space = 0, re.compile(f"[{re.escape(WHITE)}]")
    while len(text) - at > size:
        found = space.search(text, at + size - 1)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


#: Pieces of more bytes are streamed to the digests instead of being held and remembered.
LONG = 4096


@functools.cache
def _digests(path: str):
    """text -> (number of ids, and SHA-256 of ids, of the library's decoding, of the text from bytes).

    The text goes through in chunks, and the digests are fed as ids come out: what is
    held is a chunk, and of a piece longer than ``LONG`` bytes a window of symbols.
    """
    t = transducer(path)
    whole = any(c in WHITE for special in t.special for c in special)

    def entry(piece: str) -> tuple[str, str, str, int]:
        ids = t.encode_piece(piece)
        return " ".join(map(str, ids)), t.decode(ids), t.decode_text(ids), len(ids)

    memo = Memo(entry, 120_000)

    def entries(text: str) -> Iterator[tuple[str, str, str, int]]:
        for i, part in t.segments(text):
            if i is not None:
                token = t.decode([i])
                yield str(i), token, token + " ", 1
                continue
            for piece in split(normalise(part)):
                if len(piece) <= LONG:
                    yield memo[piece]
                    continue
                machine, ids = t.text_machine(), t.stream(piece[k : k + LONG].encode() for k in range(0, len(piece), LONG))
                while some := list(islice(ids, LONG)):
                    yield " ".join(map(str, some)), t.decode(some), machine(some), len(some)

    def of(text: str) -> tuple[int, str, str, str]:
        n, digests, begun = 0, [hashlib.sha256() for _ in range(3)], False
        for chunk in [text] if whole else chunks(text):
            made = entries(chunk)
            while found := list(islice(made, 8192)):
                columns = list(zip(*found))
                n += sum(columns[3])
                for digest, strings in zip(digests[:2], columns):
                    digest.update(((" " if begun else "") + " ".join(strings)).encode())
                digests[2].update("".join(columns[2]).encode())
                begun = True
        return n, *(d.hexdigest() for d in digests)

    return of


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode each whole text and decode it again: ids' and decoded text's digests per row.

    ``decoded_sha256`` is of what the library's decode gives (for a file without decoder
    the token strings, joined by spaces); ``text_sha256`` of the pieces of the text itself,
    from the tokens' bytes through the byte-to-text machine, a space after each.
    Narrow: no shuffle, one Arrow pass.  Null text counts as empty (no tokens,
    digests of the empty string); a null doc_id stays null; repeated rows give
    repeated results; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        of = _digests(path)
        for batch in batches:
            rows = [of(x or "") for x in batch.column(1).to_pylist()]
            n, *digests = map(list, zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text, as an array (same rules as ``round_trip``)."""

    def run(batches):
        import pyarrow as pa

        t = transducer(path)
        for batch in batches:
            ids = [t.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")

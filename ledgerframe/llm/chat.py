"""Operator 7: chat formatting at token level.

The template, as text::

    <|im_start|>role
    content<|im_end|>
    (newline)

Roles and contents are encoded by themselves, with special strings taken as
ordinary text, and the two marks are spliced in as reserved ids above the
vocabulary, so no content can make a mark.  Control strings inside a content are
escaped all the same (a backslash after the first character; one more where there
are some already), so the formatted text can be parsed too.  The loss mask is a
prefix sum over +1 and -1 at the borders of the assistant's contents.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]")
MARKS = ("<|im_start|>", "<|im_end|>")
_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """No control string is left; ``unescape`` gives the text back.  No two control
    strings overlap (none has its first character again inside), so one pass is enough."""
    return _PLAIN.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m.group()[0] + m.group()[2:] if m.group()[1] == "\\" else m.group(), text)


class Formatter:
    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size()
        self.start, self.end = first, first + 1

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one turn."""
        head, body, tail = self._ids(escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"), self._ids(escape(text)), self._ids("\n")
        ids = np.array([self.start, *head, *body, self.end, *tail], np.uint32)
        border = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            border[1 + len(head)] += 1
            border[1 + len(head) + len(body)] -= 1
        return ids, np.cumsum(border[:-1]).astype(np.uint8)

    def decode(self, ids: Iterable[int]) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def render(self, ids: np.ndarray) -> str:
        """The formatted text."""
        out, run = [], []
        for i in ids.tolist():
            if i >= self.start:
                out += [self.decode(run), MARKS[i - self.start]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.decode(run)])

    def parse(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns in ids."""
        starts, ends = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        for a, b in zip(starts, ends):
            role, _, text = self.decode(ids[a + 1 : b].tolist()).partition("\n")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
            yield role, unescape(text)

    def under_mask(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """The unescaped text under the mask of one turn."""
        return unescape(self.decode(ids[mask.astype(bool)].tolist()))


@functools.cache
def formatter(path: str) -> Formatter:
    """One per Python worker."""
    return Formatter(path)


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per turn: conv_id, turn, role, ids and loss mask (ids as little-endian
    unsigned 32-bit integers, the mask one byte an id).

    Narrow: turns are encoded where they lie and nothing is held but one batch.  Null
    text or role counts as empty; a null conv_id is a conversation of its own; repeated
    rows are all kept; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        f = formatter(tokenizer)
        for batch in batches:
            made = [f.turn(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ids, masks = pa.array([a.astype("<u4").tobytes() for a, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, masks], ["conv_id", "turn", "role", "input_ids", "loss_mask"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, input_ids binary, loss_mask binary")


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Each formatted row decoded: conv_id, turn, what was said (role and text), the text under the mask, formatted_chars.  Narrow."""

    def run(batches):
        f = formatter(tokenizer)
        names = ["conv_id", "turn", "role", "text", "turns", "loss", "formatted_chars"]
        for batch in batches:
            rows = []
            for ids, mask in zip(*(batch.column(c).to_pylist() for c in ("input_ids", "loss_mask"))):
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                said = list(f.parse(ids))
                rows.append(("".join(r for r, _ in said), "".join(t for _, t in said), len(said), f.under_mask(ids, mask) if mask.any() else "", len(f.render(ids))))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return formatted.mapInArrow(run, "conv_id long, turn long, role string, text string, turns long, loss string, formatted_chars long")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from ids and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows may come in any order and place.  They are decoded where they lie; then a
    conversation is brought together in the order of turn (nulls first), role, text.
    The digests follow each other turn by turn, so one conversation is read by one task;
    that keeps running digests only and takes constant memory however long it is.
    """

    def run(batches):
        state: list | None = None
        out: list[tuple] = []

        def closed(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            for conv, _, role, text, turns, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += turns
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield _rows(out)
            out = []
        if state is not None:
            yield _rows([closed(state)])

    turns = read_turns(formatted, tokenizer)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

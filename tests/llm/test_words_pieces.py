"""Pieces of plain letters skip the library's front end and get the ids of the whole encoder."""

import itertools
import string
import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

from ledgerframe.llm import words  # noqa: E402


def test_plain_pieces_get_the_ids_of_the_whole_encoder():
    encoder = words.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = ["".join(x) for n in (1, 2, 3) for x in itertools.product(string.ascii_lowercase, repeat=n)]
    plain += [("q" * n) for n in (50, 300)] + ["eresthing", "startoftext", "endoftext"]
    assert [encoder._piece(p) for p in plain] == [encoder._whole(p) for p in plain]
    seen = []
    encoder._whole = lambda text: seen.append(text) or b""
    encoder.ids("plain letters, 12 and naïve")
    assert sorted(seen) == [",", "1", "2", "naïve"] or sorted(seen) == [",", "12", "naïve"]


@pytest.mark.parametrize("prop", ["L", "N"])
def test_classes_are_those_of_one_call_over_all_characters(prop, monkeypatch):
    found = words._ranges.__wrapped__(prop)
    for block in (sys.maxunicode + 1, 1000):
        monkeypatch.setattr(words, "BLOCK", block)
        assert words._ranges.__wrapped__(prop) == found


def test_a_worker_that_loads_the_encoder_stays_small():
    code = """
import re, public_tokenizers
from ledgerframe.llm.words import library_encoder
encoder = library_encoder(public_tokenizers.path("word_bpe_49k.json"))
encoder.ids("plain"), encoder.ids("\\u03bb\\u03cc\\u03b3\\u03bf\\u03c2")
print(int(re.search("VmHWM:\\\\s+(\\\\d+)", open("/proc/self/status").read())[1]) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(words.__file__).parents[2]).stdout
    assert int(out.split()[-1]) < 200

"""Closing marks are parted from words before ids are looked up: the same ids, and a word is learnt once."""

from __future__ import annotations

import random

import numpy as np

from pulsegrid.llm import packing
from pulsegrid.llm.queries import tokenizer_path


def test_ids_of_odd_texts_are_those_of_whole_texts():
    rnd, enc = random.Random(5), packing._Tokens(tokenizer_path())
    alphabet = ["a", "Be", "zoé", "É", "ß", "=", "̸", "é", "1", "42", ".", "...", ",", "'s", "'", "<", "<|endoftext|>", ")", "!?", "\x1c", "中", " ", "\n", "\t", " "]
    values = ["".join(rnd.choices(alphabet, k=rnd.randrange(12))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode([v.encode() for v in values])]
    assert got == [enc.t.encode(v, add_special_tokens=False).ids for v in values]
    assert list(enc.encode([None, b"", b" \n "])) == [b""] * 3


def test_a_word_is_learnt_once_whatever_closes_it():
    enc = packing._Tokens(tokenizer_path())
    list(enc.encode([b"Plinth plinth. plinth, plinth?! 7. plinth..."]))
    assert enc.kept.keys() - {b""} == {b"plinth", b".", b",", b"?!", b"7", b"..."}

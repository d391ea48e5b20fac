"""Byte-level BPE of texts with very long runs: the ids of tiktoken where it can, and a round trip where it can't."""

import random

import numpy as np
import public_tokenizers
import pytest

from quadloom.llm import byte_bpe

RAW = open(public_tokenizers.path(byte_bpe.RANKS), "rb").read()
N = byte_bpe.PART_CHARS


def ids(text):
    return byte_bpe._piece_encoder(RAW, public_tokenizers.PATTERN).ids([byte_bpe._pieces(text.encode())])[0]


def test_white_space_around_the_limit():
    plain = byte_bpe.codec(RAW, public_tokenizers.PATTERN)[0]
    rng = random.Random(1)
    spaces = " \n\t\xa0　\x85\r"
    some = [lambda: "ab", lambda: " c", lambda: "1", lambda: ".", lambda: "\n", lambda: " " * rng.randint(1, 3), lambda: "".join(rng.choices(spaces, k=N + rng.randint(-2, 300))), lambda: rng.choice(spaces) * (N + rng.randint(-2, 2))]
    for _ in range(12):
        text = "".join(rng.choice(some)() for _ in range(rng.randint(1, 7)))
        assert ids(text).tolist() == plain.encode_ordinary(text)


@pytest.mark.parametrize("char", list("a1 \n.é漢"))
def test_five_million_characters(char):
    text = "x" + char * 5_000_000 + "y"
    data, _ = byte_bpe.laid_out(ids(text), *byte_bpe.id_strings(RAW, public_tokenizers.PATTERN))
    assert np.asarray(data).tobytes().decode() == text

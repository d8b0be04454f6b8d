"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.Codec.of(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_librarys(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decoder.decode(CODEC.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_machine_replaces_like_python(data):
    out, pending = "", b""
    for i in range(len(data)):
        text, pending = bpe.utf8_step(pending, data[i : i + 1])
        out += text
    if pending:
        out += "�"
    assert out == data.decode("utf-8", "replace")


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "\U0001f600" * 3000, " " * 10000, "".join(random.Random(3).choices("abcdefgh", k=30000))])
def test_very_long_pieces(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_a_full_machine_still_encodes():
    small = bpe.Transducer(bpe.load_ranks(PATH), max_states=3)
    for word in ("tokenization", " hello", "Überraschung"):
        assert small.encode(word.encode()) == LIBRARY.encode_ordinary(word)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hello  world\n", "x"), (5, "ß" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.digest(docs, PATH, PATTERN).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == 5
    for r, text in zip(got, ["", "", "", "ß" * 5000, "hello  world\n"]):
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs, PATH, PATTERN).where("doc_id = 1").first().ids == []
    assert bpe.digest(docs.limit(0), PATH, PATTERN).count() == 0

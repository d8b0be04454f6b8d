"""Huffman-coded token files: best lengths, blocks, and round trips against the tokenizers library."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from leafmill.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_best_and_limited():
    rng = random.Random(1)
    for n in (2, 3, 17, 300):
        counts = np.array([int(rng.paretovariate(0.6)) for _ in range(n)])
        lengths = token_output.code_lengths(counts, 40)
        assert (counts * lengths).sum() == huffman_cost(counts.tolist())
    steep = np.array([2**k for k in range(30)])
    lengths = token_output.code_lengths(steep, 8)
    assert lengths.max() <= 8 and sum(2.0**-x for x in lengths) <= 1
    assert token_output.code_lengths(np.array([5])).tolist() == [1]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.05, n) * 7, 49407).astype(np.uint32)
        at, counts = np.unique(ids, return_counts=True)
        code = token_output.Code(at.astype(np.int64), token_output.code_lengths(counts))
        payload = token_output.pack(code, [4, -9], [ids[: n // 2], ids[n // 2 :]])
        doc_ids, lengths, back = token_output.unpack(code, payload)
        assert doc_ids.tolist() == [4, -9] and lengths.tolist() == [n // 2, n - n // 2] and (back == ids).all()


def test_written_ids_are_the_librarys(spark, tmp_path):
    texts = [None, "", "Hello, World! it's 3.14", "naïve café x y\tz\n", "İstanbul ǅ ﬁ", "don't stop." * 50, "中文 テスト emoji 😀", "a" * 3000, " "]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    token_output.write(docs, PATH, 2, str(tmp_path / "ids"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read(spark, str(tmp_path / "ids")).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i * 3] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_repeated_and_null_ids_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    token_output.write(docs, PATH, 2, str(tmp_path / "a"))
    got = sorted((r.doc_id is not None, r.start, r.n_tokens) for r in token_output.read(spark, str(tmp_path / "a")).collect())
    assert got == [(False, 0, 2), (True, 2, 3), (True, 5, 3)]
    token_output.write(docs.limit(0), PATH, 2, str(tmp_path / "b"))
    assert token_output.read(spark, str(tmp_path / "b")).count() == 0


def test_marks_around_words_are_the_librarys():
    rng = random.Random(7)
    pieces = [*"abIJTs SKéİ̇̌ǎßक़ŉ'\".,-<|>_#1² \t\n\x1f Σσ漢", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]
    tokens = token_output.Tokens(PATH)
    for _ in range(10):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(15))) for _ in range(400)]
        ids, counts = tokens.encode(pa.array(texts), 2)
        want = [[*e.ids, 2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_words_beyond_those_that_are_kept(monkeypatch):
    monkeypatch.setattr(token_output, "MAX_WORDS", 3)
    monkeypatch.setattr(token_output, "MAX_CORES", 3)
    tokens = token_output.Tokens(PATH)
    for _ in range(3):
        texts = ["alpha beta gamma delta, epsilon!", None, "", "zeta alpha (eta) 12 theta\nbeta"]
        ids, counts = tokens.encode(pa.array(texts), 70000)
        want = [[*e.ids, 70000] for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert len(tokens.known) <= 3

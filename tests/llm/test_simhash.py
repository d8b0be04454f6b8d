"""SimHash links and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from leafmill.llm import simhash
from leafmill.llm.components import components


def roots_of(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "a b c a b c a b d", "É é ÀB c D E\x0bf g", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_keep_every_component(spark):
    rng, fps = random.Random(5), []
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.append(at)
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    want = roots_of(fps, pairs)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=16)
    got = {r.node: r.root for r in components(links).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    unsigned = {k % 2**64: got.get(k, k) % 2**64 for k in signed}
    assert groups(unsigned) == groups(want)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, None), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_that_do_not_converge_raise(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"), rounds=1)


def words(rng, n):
    return [rng.choice("alder birch cedar elm fir gum hazel ivy juniper kapok larch maple".split()) + str(rng.randrange(500)) for _ in range(n)]


def similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_are_grouped_and_others_not(spark):
    rng, docs, near = random.Random(11), [], []
    for k in range(60):
        base = words(rng, rng.randint(60, 400))
        other = list(base)
        for _ in range(max(1, len(base) // 60)):
            other[rng.randrange(len(other))] = "changed"
        docs += [base, other]
        near.append((2 * k, 2 * k + 1, similarity(base, other)))
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(500, ""), (501, None), (502, docs[0][0]), (503, " ".join(docs[0])), (None, "x")]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = [(a, b) for a, b, s in near if s >= 0.8]
    assert len(sure) > 20 and sum(got[a] == got[b] for a, b in sure) >= 0.97 * len(sure)
    assert all(got[a] != got[b] for a, b, s in near if s < 0.8)
    assert len({got[2 * k] for k in range(60)}) == 60
    assert got[503] == 0 and got[500] == got[501] == 500 and got[502] == 502


def test_large_group_with_strangers_in_blocks(spark):
    rng = random.Random(2)
    base = words(rng, 300)
    rows = []
    for i in range(400):
        w = list(base)
        w[i % 300] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(rng, 100))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


def test_groups_of_a_family_agree_with_brute_force(spark, monkeypatch):
    """Members of all similarities to each other, in blocks, few partners at a time."""
    monkeypatch.setattr(simhash, "NEAREST", 1)
    rng = random.Random(3)
    base, texts = words(rng, 120), []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 4)] = words(rng, 2)
        texts.append(w)
    pairs = [(a, b) for a in range(150) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    want = roots_of(range(150), pairs)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    assert 10 < len(set(want.values())) < 140
    assert all(want[i] == want[got[i]] for i in got)  # never more than brute force joins
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def test_repeated_ids_hang_together(spark):
    rows = [(4, "one two three four five six"), (4, "quite another text of some words"), (7, "quite another text of some words"), (2, "one two three four five six"), (9, "alone here")]
    got = {(r.doc_id, r.component_id) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(4, 2), (7, 2), (2, 2), (9, 9)}


def test_keep(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words here to stay put", "z"), (None, "a b c d e f g", "n"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in kept.collect()) == [(False, 1, "y"), (False, 2, "z"), (False, 9, "e"), (True, 0, "n")]
    assert simhash.keep(docs.limit(0)).count() == 0


def test_query_rows(spark):
    rows = [(5, "same text of words here"), (4, "same text of words here"), (8, None), (7, "")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.hexed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = f"{plain_fingerprint(rows[0][1]):016x}"
    assert got == {5: (want, 4), 4: (want, 4), 8: ("0" * 16, 7), 7: ("0" * 16, 7)}

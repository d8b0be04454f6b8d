"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from leafmill.llm import spelling


def counted(docs):
    """The words and their counts, from the texts themselves."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    """word to (form, root, n, n_near, form_n), every pair of words compared."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def texts(rng, stems, n_docs):
    def vary(w):
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            i, how = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + ("" if how == 0 else rng.choice("abcé")) + w[i + (how == 1) :] if how < 2 else w[:i] + rng.choice("abcé") + w[i:]
        return w
    return [(i, rng.choice([" ", ", ", "\n"]).join(vary(rng.choice(stems)) if rng.random() < 0.5 else stems[0] for _ in range(rng.randint(0, 80)))) for i in range(n_docs)]


@pytest.mark.parametrize("hot", [200, 2, 0])
def test_all_pairs(spark, monkeypatch, hot):
    """Segments are cut further beyond ``HOT`` words; the pairs stay the same."""
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(5)
    stems = ["Spelling", "variants", "aaaaaaa", "abababab", "Größenordnung", "élémentaire", "prefixone", "prefixtwo", "prefixoneb"]
    docs = texts(rng, stems, 120)
    words = counted(docs)
    assert len(words) > 100
    got = spelling.grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()]
    assert len(rows) == len(words) and set(rows) == grouped(words)


def test_roots_follow_chains(spark):
    docs = [(None, " ".join(["abcdefg"] * 2000 + ["abcdefgh"] * 150 + ["abcdefghi"] * 12 + ["alonealone"] * 3))]
    words = counted(docs)
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.grouped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == grouped(words) and len(got) == 4
    assert {r[2] for r in got} == {"abcdefg", "alonealone"}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "short words only x" * 3), (4, "repeated repeated"), (4, "repeated repeated"), (5, "ÀÉÎÕÜàé×÷ ÀÉÎÕÜàé×÷"), (6, "seven77seven " * 3), (7, "einsehrlangestextstück " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n int, word string")
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.grouped(df).collect()}
    assert got == grouped(counted(rows)) and len(got) == 3
    none = spelling.grouped(df.limit(0))
    assert none.count() == 0 and none.columns == ["word", "n", "n_near", "form", "form_n", "root"]

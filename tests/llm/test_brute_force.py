"""Line dedup, decontamination and the classifiers against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from leafmill.llm import decontaminate, language_id, line_dedup, ngrams, toxicity

# -- line dedup ----------------------------------------------------------------


def units(text):
    return [u for u in re.split(r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)", text) if u]


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(5, 12))) + rng.choice([". ", "! ", ".\n", "\n\n"])


@pytest.mark.parametrize("seed", [1, 2])
def test_no_repeat_is_left_and_nothing_unique_is_lost(spark, seed):
    """Every run of repeated units, wherever it begins and ends, against all runs of all texts."""
    rng = random.Random(seed)
    pool = [[sentence(rng) for _ in range(rng.randint(3, 9))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(rng) for _ in range(rng.randint(2, 6))]
        for _ in range(rng.choice((0, 1, 1, 2))):
            run = rng.choice(pool)
            a = rng.randint(0, len(run) - 2)
            at = rng.randint(0, len(parts))
            parts[at:at] = run[a : rng.randint(a + 2, len(run))]
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs.repartition(6)).collect()}
    assert got == {r.doc_id: r.text for r in line_dedup.dedup(docs.coalesce(1)).collect()}
    whole = Counter(u.rstrip() for _, t in rows for u in units(t))
    for i, t in rows:  # what stands once stays, in its order, and every repeated unit stays somewhere
        own = [u.rstrip() for u in units(t) if whole[u.rstrip()] == 1]
        left = [u.rstrip() for u in units(got[i])]
        assert [u for u in left if whole[u] == 1] == own
    everything = "\n".join(got.values())
    assert all(u in everything for u in whole)
    seen = Counter()
    for t in got.values():
        own = units(t)
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = "".join(own[a:b]).rstrip()
                if len(run) >= line_dedup.MIN_CHARS:
                    seen[run] += 1
                    break
    assert max(seen.values()) == 1 and sum(map(len, got.values())) < sum(len(t) for _, t in rows)


# -- decontamination -----------------------------------------------------------

D = decontaminate


def bare(text):
    return re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text).translate({ord(c): None for c in D.PUNCTUATION})


def template(text):
    text = regex.sub(r"(?<=[\p{L}\p{N},;][ \n])\p{Lu}[\p{L}\p{N}'’-]*", D.NAME, text)
    text = re.sub(r"[0-9]+(?:[.,][0-9]+)*", D.NUMBER, text)
    text = regex.sub(rf"{D.NUMBER}( ?)(?i:{D.UNITS}|[%°])(?![\p{{L}}\p{{N}}])", rf"{D.NUMBER}\1{D.UNIT}", text)
    return text.translate({ord(c): None for c in D.PUNCTUATION}).lower()


def words(text):
    return [w for w in re.split(r"[ \t\n\r\x0b\f]+", text) if w]


def windows(text, sizes):
    """(size, exact, words) to places."""
    out = defaultdict(list)
    for exact, own in ((False, words(template(text))), (True, words(bare(text).lower()))):
        for size in sizes:
            for i in range(len(own) - size + 1):
                out[size, exact, tuple(own[i : i + size])].append(i)
    return out


def judged(doc, item):
    """(n_windows, item_windows, coverage, n_slots, consistent, leaked) of a document and an item; None without a shared window."""
    marks = {D.NAME, D.NUMBER, D.UNIT}
    size = {n: D.WINDOW if n >= D.WINDOW else n for n in (len(words(template(item))), len(words(bare(item).lower())))}
    mine = {}
    for exact, own in ((False, words(template(item))), (True, words(bare(item).lower()))):
        n = size[len(own)]
        if n >= D.LEAST:
            for k, at in windows(item, [n]).items():
                if k[1] == exact and (exact or 2 * sum(not marks & set(w) for w in k[2]) >= n):
                    mine[k] = at
    theirs = windows(doc, {k[0] for k in mine})
    pairs = {(a, b, k[0], k[1]) for k in mine for b in mine[k] for a in theirs.get(k, [])}
    if not pairs:
        return None
    groups = defaultdict(set)
    near, last = 0, None
    for p in sorted(pairs, key=lambda p: p[0] - p[1]):
        shift = p[0] - p[1]
        near += last is not None and shift - last > D.GAP
        last = shift
        groups["same", shift].add(p)
        groups["near", near].add(p)
    total = len({b for at in mine.values() for b in at})
    templates = len({b for k, at in mine.items() if not k[1] for b in at})
    t, d, i = words(template(doc)), words(bare(doc)), words(bare(item))
    get = lambda xs, at: xs[at] if 0 <= at < len(xs) else None
    low = lambda w: w and w.lower()
    best = []
    for m in groups.values():
        steps = {(a + k, b + k) for a, b, n, _ in m for k in range(n)}
        slots = {(low(get(i, b)), low(get(d, a))) for a, b in steps if get(t, a) and marks & set(get(t, a))}
        n_t, n_e = (len({b for _, b, _, exact in m if exact == e}) for e in (False, True))
        by_words = n_t == 0 or n_e * templates > n_t * total
        n, of = (n_e, total) if by_words else (n_t, templates)
        consistent = len(slots) == len({b for b, _ in slots}) or n_e == total
        coverage = round(n / of, 6)
        best.append((consistent and (coverage >= D.SHARE or n >= D.WINDOWS), coverage, n, consistent, len(slots), of))
    leaked, coverage, n, consistent, n_slots, of = max(best)
    return n, of, coverage, n_slots, consistent, leaked


def test_leaks_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    names, verbs = ["Boston", "Lyon", "Turin", "Denver"], "travels carries counts leaves meets holds".split()
    filler = lambda n: " ".join(rng.choice("we walked along rivers and talked until evening came".split()) for _ in range(n))
    item = lambda: f"A {rng.choice(['train', 'boat'])} from {rng.choice(names)} {rng.choice(verbs)} {rng.randint(2, 99)} km in {rng.randint(2, 9)} hours. Then {rng.choice(names)} {rng.choice(verbs)} {filler(rng.randint(0, 8))} {rng.choice(names)}?"
    items = [(i, item()) for i in range(8)] + [(8, "five words are just enough"), (9, "too short"), (10, "1 2 3 4 5 6 7 8 9 10 11")]

    def change(text):
        for _ in range(rng.randint(0, 3)):
            a = rng.choice([*names, r"\d+", " ", rng.choice(verbs)])
            text = re.sub(a, lambda m: {" ": " so "}.get(m[0], str(rng.randint(2, 99)) if m[0].isdigit() else rng.choice(names)), text, count=1)
        return text

    docs = [(i, f"{filler(rng.randint(0, 9))} {change(rng.choice(items)[1])} {filler(6)} {change(rng.choice(items)[1]) if i % 3 else ''}") for i in range(60)] + [(90, ""), (91, filler(30))]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.coverage, r.n_slots, r.consistent, r.leaked) for r in got}
    want = {(i, j): x for i, t in docs for j, u in items if (x := judged(t, u))}
    assert set(found) == set(want)
    assert {k: v[-1] for k, v in found.items()} == {k: v[-1] for k, v in want.items()} and found == want
    assert 10 < sum(v[-1] for v in want.values()) < len(want)


# -- classifiers ---------------------------------------------------------------


def hashed(text, orders, bits):
    """The buckets of all n-grams, one by one."""
    c = [ord(x) for x in f" {text.lower()} "]
    mask, out = 0xFFFFFFFF, []
    for n in orders:
        for i in range(len(c) - n + 1):
            h = c[i] * 2654435761 & mask
            for k in range(1, n):
                h = ((h ^ h >> 15) * 0x9E3779B1 + c[i + k] * 0x85EBCA77) & mask
            out.append(((h ^ h >> 13) * 0xC2B2AE35 & mask) >> (32 - bits))
    return out


def test_hashes_of_ngrams():
    for text in ("", "a", "Ab", "größer 😀 than", "x" * 50):
        assert sorted(hashed(text, (1, 2, 3), 16)) == sorted(ngrams.hashed(text, (1, 2, 3), 16).tolist())
        assert sorted(hashed(text, (3, 4, 5), 18)) == sorted(ngrams.hashed(text, (3, 4, 5), 18).tolist())


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_sparse_products(monkeypatch, chunk):
    monkeypatch.setattr(ngrams.Rows, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    dense = (rng.random((9, 20)) < 0.3) * rng.standard_normal((9, 20)).astype(np.float32)
    dense[4] = 0
    rows = ngrams.Rows([np.flatnonzero(r).astype(np.int32) for r in dense], [r[r != 0] for r in dense], 20)
    w, d = rng.standard_normal(20), rng.standard_normal(9).astype(np.float32)
    assert np.allclose(rows.times(w), dense @ w) and np.allclose(rows.transposed_times(d), dense.T @ d, atol=1e-5)


def gradient(x, y, w, b, penalty):
    p = 1 / (1 + np.exp(-(x @ w + b)))
    return np.append(x.T @ (p - y) + penalty * w, (p - y).sum())


def test_toxicity_is_the_regression_of_scaled_features():
    """Ratios, features and scores computed one by one; the fit is at the optimum of its loss."""
    rng = random.Random(3)
    words_of = {1: "nasty brute vile filth".split(), 0: "kindly gentle pleasant nice".split()}
    texts = [" ".join(rng.choice(words_of[i % 2] + "the of and to".split()) for _ in range(12)) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    model = toxicity.fit(texts, labels, penalty=1e-3)
    held = [set(hashed(t, toxicity.ORDERS, toxicity.BITS)) for t in texts]
    counts = [Counter(b for h, y in zip(held, labels) if y == c for b in h) for c in (1, 0)]
    ratio = {b: math.log((counts[0][b] + 1) / (labels.sum() + 2)) - math.log((counts[1][b] + 1) / ((labels == 0).sum() + 2)) if counts[0][b] + counts[1][b] >= 3 else 0.0 for b in set().union(*held)}
    index = {b: k for k, b in enumerate(sorted(ratio))}
    x = np.zeros((60, len(index)))
    for r, h in enumerate(held):
        for b in h:
            x[r, index[b]] = ratio[b] / math.sqrt(len(h))
    own = np.array([model.weights[b] / ratio[b] if ratio[b] else 0.0 for b in index])
    g = gradient(x, labels, own, model.intercept, 1e-3 * 60)
    assert np.abs(g).max() < 0.02 * np.abs(gradient(x, labels, own * 0, 0.0, 0.06)).max()
    for t in [*texts[:6], "", None, "unseen words"]:
        h = set(hashed(t or "", toxicity.ORDERS, toxicity.BITS))
        z = sum(float(model.weights[b]) for b in h) / math.sqrt(max(1, len(h))) + model.intercept
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert model.score(texts[1]) > 0.9 > 0.1 > model.score(texts[0])


def test_languages_are_chosen_by_votes_of_machines():
    """Margins by the machines one by one, families first."""
    words_of = {"en": "the and of with this", "de": "der und von mit dies", "nl": "het en van met deze", "fr": "le et de avec cette", "es": "el y del con esta"}
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(ws.split()) for _ in range(15)), lang) for lang, ws in words_of.items() for _ in range(30)]
    model = language_id.fit([t for t, _ in rows], [lang for _, lang in rows])
    groups = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    assert sorted(model.machines) == sorted([("", "germanic", "romance"), ("germanic", "de", "en"), ("germanic", "de", "nl"), ("germanic", "en", "nl"), ("romance", "es", "fr")])
    for text, lang in [*rows[::7], ("12 der und 34", "de"), ("et", "fr")]:
        found = hashed(text, language_id.ORDERS, language_id.BITS)
        chance = {}
        for k, m in enumerate(model.machines):
            margin = sum(float(model.weights[b, k]) for b in found) / len(found) + model.intercepts[k]
            chance[m] = 1 / (1 + math.exp(-2 * max(-15, min(15, margin))))

        def choose(level, names):
            if len(names) == 1:
                return names[0], 1.0
            won = {n: [c if a == n else 1 - c for (at, a, b), c in chance.items() if at == level and n in (a, b)] for n in names}
            best = min(names, key=lambda n: (-sum(p > 0.5 for p in won[n]), -sum(won[n]), n))
            return best, sum(won[best]) / len(won[best])

        group, a = choose("", sorted(groups))
        name, b = choose(group, groups[group])
        assert model.predict(text)[0] == name and model.predict(text)[1] == pytest.approx(a * b, abs=1e-5)
        assert name == lang
    assert model.predict(None) == model.predict("12 !") == ("und", 0.0)

"""Toxicity, language, quality and the fits behind them: held-out accuracy, plain versions, edge cases."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_separates_held_out_documents(spark):
    docs, labels = common.table(spark, SF, "documents").select("doc_id", "text"), common.table(spark, SF, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(common.held_out(F.col("doc_id")))
    rows = [(r.toxic, r.score, r.predicted) for r in scored.collect()]
    good, bad = [s for t, s, _ in rows if t == 1], [s for t, s, _ in rows if t == 0]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(good) > 3 and wins > 0.9
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in rows)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert [(r.score, r.predicted) for r in rows] == [(rows[0].score, 0)] * 3
    kept = toxicity.keep(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert toxicity.keep(docs.limit(0), none).count() == 0


def test_language_of_held_out_documents(spark):
    docs = common.table(spark, SF, "documents")
    model = language_id.train(docs)
    found = language_id.predict(docs.where(common.held_out(F.col("doc_id")) & (F.length("text") > 100)), model)
    rows = [(r.lang, r.lang_pred) for r in found.select("lang", "lang_pred").collect()]
    assert len(rows) > 100 and np.mean([a == b for a, b in rows]) > 0.97


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (4, "123 !?", "en"), (5, "words", None)], "doc_id long, text string, lang string")
    rows = language_id.predict(docs, language_id.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3
    model = language_id.train(docs)
    assert [model.predict(t)[0] for t in ("\u00b2", "\u00bd", "\u2163", "_ 7", "\u00e9")] == ["und", "und", "und", "und", "en"]  # numbers aren't letters
    empty = language_id.train(docs.limit(0))
    assert language_id.predict(docs, empty).where("lang_pred = 'und'").count() == 4


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "x x x x", "line # one\nline # one\n\n \né ü\n", "a b c d a b c d", "\x1fa\x0bb\x0cc\x1d d"])
def test_counts(text):
    assert quality.counts(text) == plain_counts(text)


def test_quality_keeps_most_and_drops_outliers(spark):
    rows = [(i, " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(80)), "en", "s") for i in range(300)]
    rows += [(900, "### " * 20 + " ".join(f"a{k} ###" for k in range(80)), "en", "s"), (901, "same few words " * 50, "en", "s"), (902, None, None, None), (903, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(got[i].kept for i in range(300))
    assert not got[900].kept and got[900].reasons and got[901].base_failed and not got[902].kept and not got[903].kept
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_bounds_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "MIN_ROWS", 40)  # so that pairs, languages and all documents give bounds
    docs = common.table(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source"))).withColumn("kept", F.lit("x"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("lang")))
    growth = math.log(1.01 / 0.99)
    texts, groups = docs.collect(), defaultdict(list)
    measures = {}
    for r in texts:
        w, ch, sy, li, du, re_ = plain_counts_fast(r.text)
        if w >= 50 and 100 * re_ <= 50 * w:
            found = {"symbol_share": sy / ch, "dup_line_share": du / li, "repeat_share": re_ / w, "word_length": ch / w}
            measures[r.doc_id] = found
            for key in ((r.lang, r.source), r.lang, "all"):
                groups[key].append(found)

    def quantile(key, measure, q):
        buckets = sorted(math.ceil(math.log(m[measure]) / growth) if m[measure] >= 1e-4 else -math.inf for m in groups[key])
        at = buckets[max(math.ceil(q * len(buckets)), 1) - 1]
        return 0.0 if at == -math.inf else 2 * math.exp(growth * at) / (1.01 / 0.99 + 1)

    def fits(key, found):
        for measure, tail, least in quality.BOUNDS.values():
            middle = quantile(key, measure, 0.5)
            away = max(12 * abs(quantile(key, measure, tail) - middle), least)
            if found[measure] > middle + away if tail > 0.5 else found[measure] < middle - away:
                return False
        return True

    levels = {r.doc_id: next((k for k in ((r.lang, r.source), r.lang) if len(groups[k]) >= 40), "all") for r in texts}
    want = {r.doc_id: r.doc_id in measures and fits(levels[r.doc_id], measures[r.doc_id]) for r in texts}
    assert {type(k) for k in levels.values()} >= {tuple, str} and "all" in levels.values()
    for parts in (3, 17):
        assert {r.doc_id: r.kept for r in quality.judged(docs.repartition(parts)).collect()} == want


def plain_counts_fast(text):
    """As ``plain_counts``, for whole documents."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows, seen = list(zip(words, words[1:], words[2:])), defaultdict(int)
    for w in windows:
        seen[w] += 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit)

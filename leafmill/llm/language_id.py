"""Language identification in two steps: the family, then the language within it.

Both steps are one-versus-one linear support vector machines over the shares of
hashed character 1- to 3-grams. The languages are those of the training rows;
the table below groups them, and a language that it lacks is a family of its own.

Edge cases: a null text or one without any letter is ``und`` with score 0;
without training rows every text is; one learned language gets every text with
letters, at score 1. Ties go to the name that sorts first.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, ngrams

ORDERS, BITS = (1, 2, 3), 16
#: Training documents of each language, about: the fit runs on a bounded sample.
SAMPLE = 1200
#: Languages by family.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr ne pa gu ur",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "malayo-polynesian": "id ms tl jv",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    """The family of a language; region tags are ignored, unlisted languages stand alone."""
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


@dataclass
class Model:
    """Machines as columns: (level, first, second) of each, weights[bucket, machine], intercepts."""

    machines: list[tuple[str, str, str]]
    weights: np.ndarray
    intercepts: np.ndarray
    languages: list[str]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = ngrams.hashed(text, ORDERS, BITS)
        margins = self.weights[found].mean(axis=0) + self.intercepts if self.machines else np.zeros(0)
        chances = 1 / (1 + np.exp(-2 * np.clip(margins, -15, 15)))
        group, a = self.choose("", sorted({family(x) for x in self.languages}), chances)
        lang, b = self.choose(group, [x for x in self.languages if family(x) == group], chances)
        return lang, float(a * b)

    def choose(self, level: str, names: list[str], chances: np.ndarray) -> tuple[str, float]:
        """The name with most votes, and then the highest mean chance, among those of a level."""
        if len(names) == 1:
            return names[0], 1.0
        won: dict[str, list[float]] = {n: [] for n in names}
        for (at, first, second), p in zip(self.machines, chances):
            if at == level:
                won[first].append(p)
                won[second].append(1 - p)
        best = min(names, key=lambda n: (-sum(p > 0.5 for p in won[n]), -sum(won[n]), n))
        return best, sum(won[best]) / len(won[best])


def fit(texts: list[str], langs: list[str], penalty: float = 0.05) -> Model:
    """The machines of labelled texts."""
    names, width = sorted(set(langs)), 1 << BITS
    counted = [np.unique(ngrams.hashed(t or "", ORDERS, BITS), return_counts=True) for t in texts]
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c in counted]
    mean = np.bincount(np.concatenate([b for b, _ in counted]), weights=np.concatenate(shares), minlength=width) / max(1, len(texts)) if texts else np.zeros(width)
    scale = np.where(mean > 0, 1 / np.sqrt(mean + 1e-6), 0)
    values = [s * scale[b] for s, (b, _) in zip(shares, counted)]
    groups = sorted({family(x) for x in names})
    jobs = [("", a, b, [family(x) for x in langs]) for a, b in itertools.combinations(groups, 2)]
    jobs += [(g, a, b, langs) for g in groups for a, b in itertools.combinations([x for x in names if family(x) == g], 2)]
    weights, intercepts = np.zeros((width, len(jobs)), np.float32), np.zeros(len(jobs))
    for k, (_, a, b, of) in enumerate(jobs):
        own = [i for i, x in enumerate(of) if x in (a, b)]
        rows = ngrams.Rows([counted[i][0].astype(np.int32) for i in own], [values[i] for i in own], width)
        w, intercepts[k] = ngrams.svm(rows, np.array([1.0 if of[i] == a else -1.0 for i in own]), penalty)
        weights[:, k] = w * scale
    return Model([j[:3] for j in jobs], weights, intercepts, names)


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, lang) of about ``size`` documents of each language that aren't held out, chosen by their hashed ids."""
    known = docs.where("lang is not null and text is not null").where(~common.held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts, _ = common.stage(known.groupBy("lang").agg(F.count("*").alias("n_lang")), "languages")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    return known.join(common.bounded(counts), "lang").where(place * F.col("n_lang") < 1_000_000 * size).select("text", "lang")


def train(docs: DataFrame, size: int = SAMPLE) -> Model:
    """Fit on the sample, in one task; only the machines come to the driver."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["text", "lang"]), *batches])
        if rows.empty:
            return
        m = fit(rows["text"].tolist(), rows["lang"].tolist())
        yield pd.DataFrame({"machines": [[list(x) for x in m.machines]], "weights": [m.weights.tobytes()], "intercepts": [m.intercepts.tolist()], "languages": [m.languages]})

    found = sample(docs, size).repartition(1).mapInPandas(one, "machines array<array<string>>, weights binary, intercepts array<double>, languages array<string>").collect()
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), [])
    row = found[0]
    return Model([tuple(x) for x in row["machines"]], np.frombuffer(row["weights"], np.float32).reshape(1 << BITS, -1), np.array(row["intercepts"]), list(row["languages"]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    got = docs.withColumn("__lang", of("text"))
    return got.withColumn("lang_pred", F.col("__lang.lang_pred")).withColumn("score", F.col("__lang.score")).drop("__lang")

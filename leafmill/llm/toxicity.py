"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Features are the presence of hashed character 3- to 5-grams, each multiplied by
the log ratio of its smoothed shares among toxic and other training documents
and divided by the root of how many the text has; a logistic regression over
them gives the score.

Edge cases: null and empty texts are scored like a text without n-grams; rows
whose label is null are no training rows; several labels of one document count
as toxic if one is; without training rows of both classes the score is the
smoothed share of toxic ones (0 without any rows). Extra columns pass through
``score`` untouched, but for those named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, ngrams

ORDERS, BITS = (3, 4, 5), 18
#: Training documents of each class, about: the fit runs on a bounded sample.
SAMPLE = {1: 1500, 0: 3000}
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = ngrams.present(ngrams.hashed(text or "", ORDERS, BITS), BITS)
        z = self.weights[found].sum() / max(1, len(found)) ** 0.5 + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: np.ndarray, penalty: float = 2e-5) -> Model:
    """The classifier of texts labelled 0 or 1; ``penalty`` is for each text."""
    width = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
        return Model(np.zeros(width, np.float32), float(np.log(share / (1 - share))) if share else -30.0)
    found = [ngrams.present(ngrams.hashed(t or "", ORDERS, BITS), BITS) for t in texts]
    ones, zeros = np.zeros(width), np.zeros(width)
    for own, label in zip(found, labels):
        (ones if label == 1 else zeros)[own] += 1  # a text's buckets are distinct
    ratio = np.log((ones + 1) / (labels.sum() + 2)) - np.log((zeros + 1) / ((labels == 0).sum() + 2))
    ratio[ones + zeros < 3] = 0
    values = [(ratio[own] / np.sqrt(max(1, len(own)))).astype(np.float32) for own in found]
    rows = ngrams.Rows(found, values, width)
    del found, values
    weights, intercept = ngrams.logistic(rows, labels.astype(float), penalty * len(labels))
    return Model((weights * ratio).astype(np.float32), intercept)


def sample(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> DataFrame:
    """(text, toxic) of a sample of the labelled documents that aren't held out.

    A document is taken if its hashed id falls under size / (rows of its class),
    so that about ``sizes`` are taken of each class and no row is moved to choose.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~common.held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    take = F.lit(False)
    for label, size in sizes.items():
        take |= (F.col("toxic") == label) & (place < int(1_000_000 * min(1.0, size / max(1, counts.get(label, 1)))))
    chosen, _ = common.stage(known.where(take), "chosen")
    return docs.select("doc_id", "text").join(common.bounded(chosen), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> Model:
    """Fit on the sample, in one task; only the weights come to the driver."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["text", "toxic"]), *batches])
        if rows.empty:
            return
        model = fit(rows["text"].tolist(), rows["toxic"].to_numpy(int))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "intercept": [model.intercept]})

    found = sample(docs, labels, sizes).repartition(1).mapInPandas(one, "weights binary, intercept double").collect()
    if not found:
        return fit([], np.zeros(0, int))
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["intercept"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold up)."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", of("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = train(docs, labels)
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) < threshold for t in texts], dtype="bool")

    return docs.where(clean("text"))

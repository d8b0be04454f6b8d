"""Quality rules with thresholds that follow each language and source.

Every document gets four measures. For each pair of language and source, and for
each measure, a mergeable quantile sketch gathers the values: counts of buckets
whose edges grow by a constant factor, so that a quantile is right to one part
in a hundred, and sketches merge by adding their counts. The same rows give the
same sketch however they are dealt out or retried, so verdicts don't change
between runs. A sketch has about 1,200 buckets at most.

A bound lies beyond the median by a multiple of the distance from the median to
a tail quantile, and by a least distance that counts. A document whose measure
lies beyond a bound is dropped after the join with the bounds.

Pairs with few documents have unsteady quantiles, so their sketches are merged
into that of the language (and that of all documents), level by level, until
one holds ``MIN_ROWS`` values.

Edge cases: null, empty and blank texts have no words and fail the base rule;
null languages and sources are groups of their own; measures of documents that
fail the base rule don't enter the sketches. An empty table gives no rows, rows
that repeat an id are judged each by its own text, and further columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

SYMBOLS = "#*$%&|<>"
#: Fewest words, and the share of words in repeated windows (percent), of the base rule.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents that a sketch needs for bounds of its own.
MIN_ROWS = 200
#: Distances from the median to the tail quantile at which a bound lies.
WIDTH = 12.0
#: Relative error of a sketch's values; smaller values than ``LEAST`` count as zero.
ERROR, LEAST = 0.01, 1e-4
#: Bound to (measure, tail quantile, least distance from the median in the measure's own unit); a tail below the median gives a lower bound.
BOUNDS = {
    "symbol_share": ("symbol_share", 0.75, 0.05),  # symbols for each character in words
    "dup_line_share": ("dup_line_share", 0.90, 0.30),  # repeated lines among lines with words
    "repeat_share": ("repeat_share", 0.90, 0.10),  # words in repeated windows
    "word_length_high": ("word_length", 0.75, 1.0),
    "word_length_low": ("word_length", 0.25, 1.0),
}
MEASURES = sorted({measure for measure, _, _ in BOUNDS.values()})
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in them, symbols, lines with a word, such lines equal to an earlier one, words in repeated windows."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()  # bytes split at the six ASCII spaces only
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        if len(number) < n:  # else no window can come twice
            windows = list(zip(ids, ids[1:], ids[2:]))
            seen = Counter(windows)
            if len(seen) < len(windows):
                covered = -1  # the last word counted so far
                for at, window in enumerate(windows):
                    if seen[window] > 1:
                        repeated += at + 2 - max(covered, at - 1)
                        covered = at + 2
    return n, chars, sum(data.count(s.encode()) for s in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of every document."""
    common.prepare(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def work(batch: pa.RecordBatch) -> dict:
        found = list(zip(*map(counts, batch.column(3).to_pylist()))) or [()] * len(names)
        return {n: batch.column(i) for i, n in enumerate(("doc_id", "lang", "source"))} | {n: pa.array(v, pa.int64()) for n, v in zip(names, found)}

    own = docs.select("doc_id", "lang", "source", "text")
    head = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return common.per_batch(own, work, f"{head}, {COUNTS}")


def share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")


def judged(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document, and the bounds that it is beyond (``reasons``)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    shares = {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }
    rows, _ = common.stage(measured(docs).withColumn("base_failed", base).withColumns(shares), "measures")
    beyond = [F.when(F.col(m) > F.col(f"bounds.{b}") if tail > 0.5 else F.col(m) < F.col(f"bounds.{b}"), F.lit(b)) for b, (m, tail, _) in BOUNDS.items()]
    own = F.col("r.lang").eqNullSafe(F.col("of_lang")) & F.col("r.source").eqNullSafe(F.col("of_source"))
    joined = rows.alias("r").join(bounds(rows), own, "left").withColumn("reasons", F.filter(F.array(*beyond), lambda x: x.isNotNull()))
    kept = ~F.col("base_failed") & (F.size("reasons") == 0)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return joined.select("doc_id", F.col("r.lang").alias("lang"), F.col("r.source").alias("source"), *names, "base_failed", kept.alias("kept"), "reasons")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each pair and measure; bucket null holds what counts as zero."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("x")
    values = rows.where(~F.col("base_failed")).select("lang", "source", each)
    bucket = F.when(F.col("x.value") >= LEAST, F.ceil(F.log("x.value") / math.log((1 + ERROR) / (1 - ERROR))).cast("int"))
    return values.groupBy("lang", "source", "x.measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def value(bucket: Column) -> Column:
    """The value that a bucket stands for."""
    growth = (1 + ERROR) / (1 - ERROR)
    return F.when(bucket.isNull(), 0.0).otherwise(2 * F.pow(F.lit(growth), bucket) / (growth + 1))


def limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, bounds): the number of values and the bounds, the sketches being merged by ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*keys, "measure")
    upward = one.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(*keys, "measure", value(F.col("bucket")).alias("value"), F.sum("n").over(upward).alias("rank"), F.sum("n").over(one).alias("total"))
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("rank") >= q * F.col("total")), F.col("value")))
    found = []
    for name, (measure, tail, least) in BOUNDS.items():
        away = F.greatest(WIDTH * F.abs(at(measure, tail) - at(measure, 0.5)), F.lit(least))
        found.append((at(measure, 0.5) + (away if tail > 0.5 else -away)).alias(name))
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), F.struct(*found).alias("bounds"))


def bounds(rows: DataFrame) -> DataFrame:
    """(of_lang, of_source, bounds struct): one row for each pair that has documents beyond the base rule."""
    pairs, _ = common.stage(sketches(rows), "sketches")
    row = limits(pairs).first()["bounds"]  # one row of five numbers
    last = F.struct(*(F.lit(row[b]).cast("double").alias(b) for b in BOUNDS))
    enough = F.when(F.col("n") >= MIN_ROWS, F.col("bounds"))
    by_lang = limits(pairs, "lang").select(F.col("lang").alias("by_lang"), enough.alias("lang_bounds"))
    own = limits(pairs, "lang", "source").select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), enough.alias("own"))
    joined = own.join(by_lang, F.col("of_lang").eqNullSafe(F.col("by_lang")), "left")
    return joined.select("of_lang", "of_source", F.coalesce("own", "lang_bounds", last).alias("bounds"))

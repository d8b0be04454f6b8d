"""Grouping of spelling variants by an even-partition pigeonhole join.

Words are counted over all texts. Two words are near if one edit of a code point
(insertion, deletion, replacement) turns one into the other. A word's form is its
near word of largest count, if that count is at least ``RATIO`` times its own;
following forms leads to its root.

The join cuts a word of ``l`` code points into two segments, the first ``l // 2``
code points and the rest. One edit leaves one of the two as it is, and the other
word has it at a known place: the first at its start, the second at its end, one
further on where that word is one longer. So each word is indexed by its two
segments and probes with the segments of words of its own length and of one less.
Candidates are made distinct and verified by their edit distance.

Segments shared by very many words (over ``HOT``) would give as many pairs as the
square of their number. The edit then lies in what is left of the word, which is
cut into two again by the same rule, on both sides; this goes on for ``DEPTH``
levels, so a hot segment's words meet only where more of them is equal. Nothing is
dropped: what is left hot at the last level is joined as it is. Words are distinct
before the join, so a frequent word costs no more than a rare one.

Edge cases: null and empty texts have no words; a null id counts as an empty one
in the hash that deletes code points; repeated rows count each; an empty table
gives no rows; further columns are left out. A text of any length is one row of
the scan; its words leave it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: Maximal runs of these are words; only A-Z is lower-cased.
WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many occurrences loses a code point.
EVERY = 31
#: Fewest code points and occurrences of a word, and how many times as frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Indexed words that share a segment beyond which it is cut again, and how often.
HOT, DEPTH = 200, 3


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): one row for each occurrence, code points deleted as the hash of id and run says."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of enough code points and occurrences."""
    long_enough = occurrences(docs).where(F.length("word") >= LEAST_LENGTH)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def part(text: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start``, counted from 0."""
    return F.substring(text, start + 1, size)


def cut(text: Column, longer: int, key: Column) -> tuple[Column, Column, Column]:
    """Both segments and, with each, what is left, of a text that is ``longer`` than the indexed one.

    Structs of (key, rest): the key takes in the one before, so keys of all levels are of one kind.
    """
    size = F.length(text) - longer
    half = F.floor(size / 2).cast("int")
    tail = (size - half).cast("int")
    head = F.struct(F.xxhash64(key, F.lit(1), size, part(text, F.lit(0), half)).alias("key"), part(text, half, tail + longer).alias("rest"))
    back = F.struct(F.xxhash64(key, F.lit(2), size, part(text, half + longer, tail)).alias("key"), part(text, F.lit(0), half + longer).alias("rest"))
    return head, back


def segments(rows: DataFrame, longer: int) -> DataFrame:
    """The rows with ``key`` and ``rest`` cut once more: two rows for each."""
    keep = [c for c in rows.columns if c not in ("key", "rest")]
    each = F.explode(F.array(*cut(F.col("rest"), longer, F.col("key")))).alias("s")
    return rows.select(*keep, each).select(*keep, "s.key", "s.rest")


def near(words: DataFrame) -> DataFrame:
    """(a, b): each pair of near words of a staged table (word, n) once, with their counts."""
    spark = words.sparkSession
    start = words.select("word", "n", F.lit(0).cast("long").alias("key"), F.col("word").alias("rest"))
    indexed, probes, found, paths = start, {0: start, 1: start}, [], []
    for level in range(DEPTH):
        indexed, path = common.stage(segments(indexed, 0), "indexed")
        paths.append(path)
        sizes = indexed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT).select("key")
        hot, path = common.stage(sizes, "hot")
        paths.append(path)
        hot = common.bounded(hot)
        cold = indexed.join(hot, "key", "left_anti") if level < DEPTH - 1 else indexed
        indexed_next = indexed.join(hot, "key", "left_semi")
        for longer, probe in probes.items():
            mine, path = common.stage(segments(probe, longer), "probes")
            paths.append(path)
            other = mine.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
            one = cold.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
            # of equal lengths a pair is taken from its smaller word, since both index and probe have either
            met = one.join(other, "key").where((F.length("b") == F.length("a") + longer) & (F.col("a") < F.col("b") if longer == 0 else F.lit(True)))
            found.append(met.where(F.levenshtein("a", "b") == 1).select("a", "n_a", "b", "n_b"))
            probes[longer] = mine.join(hot, "key", "left_semi")
        if level == DEPTH - 1 or hot.isEmpty():
            break
        indexed = indexed_next
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs, _ = common.stage(pairs.distinct(), "near")
    for path in paths:
        common.unstage(spark, path)
    return pairs


def forms(words: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near) of every word of a staged table (word, n)."""
    pairs = near(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.col1")).alias("other_n"))
    formed = F.col("other_n") >= RATIO * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )


def grouped(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    Counts grow at least ``RATIO``-fold along forms, so there are no rings; each
    round replaces a root by its root's form's root (twice as far), until no root has one.
    """
    spark = docs.sparkSession
    words, words_path = common.stage(vocabulary(docs), "words")
    rows, _ = common.stage(forms(words), "forms")
    common.unstage(spark, words_path)
    links, path = common.stage(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = links.join(further, "root", "left")
        after, to = common.stage(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        common.unstage(spark, path)
        links, path = after.select("word", "root"), to
        if after.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

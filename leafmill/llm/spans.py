"""Places of pattern matches in a text, by DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPAN = "array<struct<start:int,end:int,value:string>>"
#: Rows that are sent to every executor; beyond this count they are joined by a shuffle.
MAX_BROADCAST = 1_000_000


#: Matches whose places are added up at once; more are added up block by block, so that time stays in proportion.
BLOCK = 128


def spans(text: Column, pattern: Column | str, when: Column | None = None) -> Column:
    """Leftmost matches that don't overlap: array of start, end (code points, end exclusive) and value.

    What lies between the matches comes from a split by the same pattern; the
    lengths of both add up to the places. ``when`` is a cheap test that texts
    with a match pass.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  computes a value once
    size = lambda p: F.length(p["gap"]) + F.length(p["value"])

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("found"))

    def within(block: Column, begin: Column) -> Column:
        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(SPAN).alias("found")), add, lambda acc: acc["found"])

    def placed(blocks: Column) -> Column:
        """The spans of all blocks, each begun where those before it end."""
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + size(p)))
        begins = F.aggregate(total, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return bound(begins, lambda starts: F.flatten(F.transform(blocks, lambda b, k: within(b, F.get(starts, k)))))

    def cut(pairs: Column) -> Column:
        n = F.ceil(F.size(pairs) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())

    pairs = F.filter(F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda p: p["value"].isNotNull())
    found = bound(pairs, lambda p: F.when(F.size(p) <= BLOCK, within(p, F.lit(0))).otherwise(bound(cut(p), placed)))
    test = F.regexp_like(text, pattern) if when is None else when & F.regexp_like(text, pattern)
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def bounded(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def letters(text: Column) -> Column:
    """The words of letters of a text, in small letters."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def occurrences(docs: DataFrame, terms: DataFrame, key: list[str], words: Callable[[Column], Column] = letters) -> DataFrame:
    """(key, term): which of the staged ``terms`` each row of ``docs`` holds among its ``words``, once each."""
    found = docs.select(*key, F.explode_outer(F.array_distinct(words(F.col("text")))).alias("term"))
    return found.join(bounded(terms), "term", "left_semi")


def document_counts(docs: DataFrame, terms: DataFrame, words: Callable[[Column], Column] = letters) -> DataFrame:
    """(term, n): in how many documents of the whole table each term occurs."""
    return occurrences(docs, terms, [], words).groupBy("term").agg(F.count("*").alias("n"))

"""Quality of rewritten documents: integrity rules, differences, repetition, images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import structure

#: The columns of ``structure.counts``, in order.
COUNTS = ["paragraphs", "headings", "items", "images", "tables", "chars"]
#: A sentence is the last 150 characters, or the 20 and more that there are, before the sign that ends it. Each stretch is met
#: once, also one that no sign ends (without a group): trying every length at every place took 25 times as long.
SENTENCE, SENTENCE_CHARS = r"([^。！？!?\n]{20,}+[。！？!?])|[^。！？!?\n]++", 151
#: Marks of list items and the like before a sentence.
BULLET = rf"^(?:{tx.SPACE}|[-*•·]|[0-9]+[.)、])+"


def integrity(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, issues, retention, low_quality): the rules on what a rewritten document lost or gained.

    Each issue is ``type:severity``. Low quality: a critical issue, or under 85 % of the characters kept.
    """
    # plain columns: those of a struct would be computed again wherever a rule reads them
    named = lambda side, prefix: [c.alias(f"{prefix}_{n}") for c, n in zip(structure.counts(F.col(side)), COUNTS)]
    rows = pairs.select(key, *named(before, "i"), *named(after, "o"))
    i, o = (lambda c: F.col(f"i_{c}")), (lambda c: F.col(f"o_{c}"))
    share = lambda c, x: F.floor(i(c) * x)

    def issue(name: str, bad: Column, critical: Column) -> Column:
        return F.when(bad, F.concat(F.lit(f"{name}:"), F.when(critical, "critical").otherwise("warning")))

    found = [
        issue("images", o("images") < i("images"), F.lit(True)),
        issue("tables", o("tables") < i("tables"), (o("tables") == 0) | (i("tables") - o("tables") >= 0.3 * i("tables"))),
        issue("items", (i("items") >= 5) & (o("items") < share("items", 0.7)), o("items") < share("items", 0.4)),
        issue("paragraphs", (i("paragraphs") >= 10) & (o("paragraphs") < share("paragraphs", 0.35)) & (o("chars") < 0.9 * i("chars")), o("chars") < 0.75 * i("chars")),
        issue("content", (i("chars") >= 1000) & (o("chars") < share("chars", 0.85)), o("chars") < share("chars", 0.7)),
        issue("expansion", (i("chars") >= 1000) & (o("chars") > 3 * i("chars")), o("chars") > 4 * i("chars")),
    ]
    retention = F.when(i("chars") > 0, F.round(100 * o("chars") / i("chars"))).otherwise(100.0)
    judged = rows.select(key, F.array_compact(F.array(*found)).alias("issues"), retention.cast("long").alias("retention"))
    low = F.exists("issues", lambda x: x.endswith(":critical")) | (F.col("retention") < 85)
    return judged.select(key, F.array_join("issues", ",").alias("issues"), "retention", low.alias("low_quality"))


def sentences(text: Column) -> Column:
    """The sentences of at least 8 characters, without white space and list marks."""
    broken = F.regexp_replace(F.regexp_replace(text, r"(?i)</(?:p|div|li|h[1-6]|tr)>|<br[^>]*>", "\n"), "<[^>]*>", "")
    parts = F.split(broken, r"[。！？!?;；\n]")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, BULLET, ""), f"{tx.SPACE}+", "")), lambda s: F.length(s) >= 8)


def content_diff(pairs: DataFrame, key: str, before: str, after: str, most: int = 60) -> DataFrame:
    """(key, removed, added, n_removed, retention): sentences of one side that the other doesn't contain."""
    rows = pairs.select(key, sentences(F.col(before)).alias("a"), sentences(F.col(after)).alias("b"), tx.compact(F.col(before)).alias("ca"), tx.compact(F.col(after)).alias("cb"))
    # a sentence that the other side has as one of its own needs no search of that side's whole text
    of = F.array_except
    lost, found = of("a", "b"), of("b", "a")
    rows = rows.select(key, "a", "b", F.filter(lost, lambda s: ~F.contains("cb", s)).alias("lost"), F.filter(found, lambda s: ~F.contains("ca", s)).alias("found"))
    each = lambda side, kinds: F.when(F.size(kinds) > 0, F.filter(side, lambda s: F.array_contains(kinds, s))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(key, F.size("a").alias("n"), each("a", "lost").alias("gone"), F.col("found").alias("new"))
    kept = F.when(F.col("n") > 0, F.round(100 * (F.col("n") - F.size("gone")) / F.col("n"))).otherwise(100.0)
    short = lambda c: F.size(F.slice(F.array_distinct(c), 1, most)).cast("long")
    return rows.select(key, short(F.col("gone")).alias("removed"), short(F.col("new")).alias("added"), F.size("gone").cast("long").alias("n_removed"), kept.cast("long").alias("retention"))


def shared(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, common, coverage): what two arrays of fingerprints have in common, by the smaller one."""
    common = F.size(F.array_intersect(a, b))
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return pairs.select(key, common.cast("long").alias("common"), F.when(smaller > 0, F.round(common / smaller, 4)).otherwise(0.0).alias("coverage"))


def end_of(text: Column, n: int, clean: Callable[[Column], Column], near: int = 20_000) -> Column:
    """The last ``n`` characters of a cleaned text.

    Only the last ``near`` are cleaned where they are enough: they must not begin
    inside a tag, and hold ``n`` characters after cleaning.
    """
    part = F.right(text, F.lit(near))
    whole_tags = ~part.rlike("^[^<]*>")
    short = (F.length(text) > near) & whole_tags & (F.length(clean(part)) > n)
    return F.right(clean(F.when(short, part).otherwise(text)), F.lit(n))


def loop_signs(text: Column) -> list[Column]:
    """Three signs of a text that runs in circles, at its end: characters, a sentence, bodies of numbered items.

    A group of up to 6 characters 15 times in the last 600; a sentence of 20 to
    150 characters 5 times among the last 10 (of 8 or more); 5 of the last 8 items
    numbered in brackets like the last one.
    """
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  binds a value that a lambda would compute again for each element
    ending = lambda items, n: F.slice(items, -F.least(F.size(items), F.lit(n)), F.lit(n))
    bare = lambda t: F.regexp_replace(t, "<[^>]+>", "")
    spaced = lambda t: F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), f"{tx.SPACE}+", " ")
    trimmed = lambda items: F.transform(items, lambda s: F.trim(s))
    spam = end_of(text, 600, bare).rlike(r"(.{1,6})\1{14,}")
    ended = F.filter(F.regexp_extract_all(end_of(text, 2500, spaced), F.lit(SENTENCE), F.lit(1)), lambda s: s != "")
    found = F.transform(ended, lambda s: F.right(s, F.lit(SENTENCE_CHARS)))
    again = lambda items: F.exists(items, lambda s: F.size(F.filter(items, lambda t: t == s)) >= 5)
    sentence = once(found, lambda f: F.when(F.size(f) >= 8, once(trimmed(ending(f, 10)), again)).otherwise(False))
    bodies = F.regexp_extract_all(end_of(text, 3000, spaced), F.lit(r"[（(]\s*[0-9]+\s*[）)]\s*([^\n（）()]{8,100})"), F.lit(1))
    like_last = lambda items: (F.length(F.element_at(items, -1)) >= 8) & (F.size(F.filter(items, lambda s: s == F.element_at(items, -1))) >= 5)
    same = once(bodies, lambda f: F.when(F.size(f) >= 5, once(trimmed(ending(f, 8)), like_last)).otherwise(False))
    return [spam, sentence, same]


def repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, char_spam, sentence_loop, same_body): the signs of ``loop_signs``; null texts show none."""
    spam, sentence, same = loop_signs(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", spam.alias("char_spam"), sentence.alias("sentence_loop"), same.alias("same_body"))


def images(pairs: DataFrame, key: str, html: str, expected: str) -> DataFrame:
    """(key, html, missing, duplicated): each expected placeholder once; lost ones are appended, strange images go."""
    token = r"__IMG_[0-9]+__"
    parts = F.split(html, token, -1)
    tokens = F.regexp_extract_all(html, F.lit(token), F.lit(0))
    # a placeholder stays where it comes first, if it is expected
    stays = lambda every, t, i: (F.array_position(every, t) == i + 1) & F.array_contains(F.col(expected), t)
    kept = tx.bound(tokens, lambda every: F.transform(every, lambda t, i: F.when(stays(every, t, i), t).otherwise("")))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    missing = F.array_except(F.col(expected), tokens)
    tail = F.when(F.size(missing) > 0, F.concat(F.lit("<p>"), F.array_join(missing, "</p><p>"), F.lit("</p>"))).otherwise("")
    bare = F.regexp_replace(F.concat(joined, tail), "(?i)<img[^>]*>", "")
    return pairs.select(key, bare.alias("html"), F.size(missing).cast("long").alias("missing"), (F.size(tokens) - F.size(F.array_distinct(tokens))).cast("long").alias("duplicated"))

"""HTML as a preview shows it: lists joined, fonts left to the style sheet, headings with ids, a table of contents.

Arrays of matches are zipped, not looked up by place, so that work stays linear in a page's length. Null stays null;
HTML without lists, styles or headings stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.rules import trimmed
from leafmill.operators.blocks import has_class

#: Properties that the style sheet decides, and ids of headings in a preview and after an edit.
OWN_FONTS, PREVIEW_ID, EDIT_ID = ("font-size", "font-family", "line-height"), "toc-h-", "toc-h-edit-"
#: A style attribute (what comes before its value, the value), an opening tag of a heading, a whole heading.
STYLE, OPENING, HEADING = r'(?i)(\s+style=")([^"]*)"', r"(?i)<(h[1-6])(\s[^>]*)?>", r"(?is)<h([1-6])\b([^>]*)>(.*?)</h\1>"


def found(html: Column, pattern: str, **groups: int) -> Column:
    """The matches of a pattern as structs of its groups."""
    return F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(i)).alias(name) for name, i in groups.items()))


def put_back(html: Column, pattern: str, written: Column) -> Column:
    """Text with the n-th match of a pattern replaced by the n-th of ``written``."""
    return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), written), F.split(html, pattern), lambda w, rest: F.concat(w, rest)), "")


def joined_lists(html: Column) -> Column:
    """Ordered lists with nothing between them as one list."""
    return F.regexp_replace(html, r"</ol>\s*<ol>", "")


def without_fonts(html: Column) -> Column:
    """Style attributes without sizes and families of fonts and heights of lines; one left empty goes."""

    def written(style: Column) -> Column:
        left = F.filter(F.split(style["value"], ";"), lambda d: ~F.lower(trimmed(F.substring_index(d, ":", 1))).isin(*OWN_FONTS))
        value = F.regexp_replace(trimmed(F.array_join(left, ";")), ";$", "")
        return F.when(value == "", "").otherwise(F.concat(style["before"], value, F.lit('"')))

    return put_back(html, STYLE, F.transform(found(html, STYLE, before=1, value=2), written))


def with_ids(html: Column) -> Column:
    """Every heading with an id; those without one are numbered from 0 in order."""
    tags = F.transform(found(html, OPENING, tag=0, name=1, attrs=2), lambda t, i: F.struct(i.alias("at"), t["tag"].alias("tag"), t["name"].alias("name"), t["attrs"].alias("attrs")))
    has_id = lambda t: t["attrs"].rlike(r"\bid=")
    kept = F.transform(F.filter(tags, has_id), lambda t: F.struct(t["at"].alias("at"), t["tag"].alias("html")))

    def numbered(t: Column, i: Column) -> Column:
        return F.struct(t["at"].alias("at"), F.concat(F.lit("<"), t["name"], F.lit(f' id="{PREVIEW_ID}'), i.cast("string"), F.lit('"'), t["attrs"], F.lit(">")).alias("html"))

    new = F.transform(F.filter(tags, lambda t: ~has_id(t)), numbered)
    return put_back(html, OPENING, F.transform(F.array_sort(F.concat(kept, new)), lambda t: t["html"]))


def preview(html: Column) -> Column:
    """Lists joined, fonts taken out, headings with ids."""
    return with_ids(without_fonts(joined_lists(html)))


def heading_text(inner: Column) -> Column:
    """What a heading reads as."""
    return trimmed(tx.decoded(F.regexp_replace(inner, "<[^>]*>", "")))


def contents(html: Column) -> Column:
    """(id, level, text) of the headings that a table of contents lists: all with text but the document's title."""
    own = r"""(?i)\bid\s*=\s*["']([^"']+)["']"""
    every = F.transform(found(html, HEADING, level=1, attrs=2, inner=3), lambda h: F.struct(h["level"].alias("level"), h["attrs"].alias("attrs"), heading_text(h["inner"]).alias("text")))
    listed = F.filter(every, lambda h: (h["text"] != "") & ~has_class(h["attrs"], "doc-title"))

    def entry(h: Column, i: Column) -> Column:
        named = F.regexp_extract(h["attrs"], own, 1)
        new = F.concat(F.lit(EDIT_ID), i.cast("string"))
        return F.struct(F.when(named == "", new).otherwise(named).alias("id"), h["level"].cast("int").alias("level"), h["text"].alias("text"))

    return F.transform(listed, entry)


def heading_fingerprints(html: Column, least: int = 4) -> Column:
    """The distinct headings of at least four characters, in order, as they are compared between chunks."""
    inner = F.regexp_extract_all(html, F.lit(HEADING), F.lit(3))
    texts = F.transform(inner, lambda x: trimmed(F.regexp_replace(x, "<[^>]+>", "")))
    return F.array_distinct(F.filter(texts, lambda t: F.length(t) >= least))

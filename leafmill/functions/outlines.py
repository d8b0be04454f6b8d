"""Column rules of outlines, captions, trailers and raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.rules import trimmed

#: What counts as an image, a placeholder, a caption, a formula's block twice, and a link of a table of contents.
IMAGE = r"""(?i)<img\s+[^>]*src=["'][^"']*["'][^>]*>"""
PLACEHOLDER = "__IMG_([0-9]+)__"
CAPTION = r"^([图表])\s*([0-9]+(?:[-.][0-9]+)*)[\s\x{3000}、.：:]*(.*)$"
FORMULA_TWICE = r"(<(?:p|div)[^>]*>\s*(?:\$[^$\n]{1,60}\$|\$\$[\s\S]{1,200}?\$\$)\s*</(?:p|div)>)\s*\1"
CONTENTS_LINK, EMPTY_ANCHOR = r'(?i)<p[^>]*>\s*<a\s+href="#_Toc[^"]*"[^>]*>[\s\S]*?</a>\s*</p>', r'(?i)<a\s+id="[^"]*"[^>]*></a>'
#: A name in brackets, as files of figures have it.
BRACKETED = r"[（(][A-Za-z_][A-Za-z0-9_\s.-]*[）)]"
#: Fixed value: the line before the headings that are sent along with a text.
TRAILER = "\n<!-- STRUCTURE_DATA -->\n"
HEADINGS = "array<struct<level:double,text:string,number:string>>"


def source_number(number: Column, scheme: str) -> Column:
    """A heading's own number as a scheme writes it; one without digits stays as it is, null is empty."""
    clean = F.regexp_replace(trimmed(F.coalesce(number, F.lit(""))), r"[.\s\x{3000}]+$", "")
    parts = F.filter(F.transform(F.split(clean, r"\."), lambda x: x.try_cast("int")), lambda n: n > 0)
    depth, last = F.size(parts), F.get(parts, F.size(parts) - 1)
    digits, written = last.cast("string"), tx.chinese(last)
    around = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    if scheme == "chinese-hierarchical":
        forms = [around("", written, "、"), around("（", written, "）"), around("", digits, "."), around("(", digits, ")")]
    elif scheme == "chapter":
        forms = [around("第", written, "章"), around("第", written, "节"), around("", written, "、"), digits]
    elif scheme in ("decimal", "decimal-nested"):
        forms = [around("", clean, "."), clean, clean, clean]
    else:
        forms = [F.lit("")] * 4
    return F.when(depth == 0, clean).otherwise(F.get(F.array(*forms), F.least(depth, F.lit(4)) - 1))


def caption(text: Column) -> Column:
    """(kind, number, title, key) of a numbered caption; null for other lines. ``key`` is what titles are compared by."""
    return tx.bound(tx.plain(text), caption_of)


def caption_of(plain: Column) -> Column:
    """``caption`` of plain text."""
    part = lambda i: F.regexp_extract(plain, CAPTION, i)
    number = F.replace(part(2), F.lit("."), F.lit("-"))
    return F.when(part(1) != "", F.struct(part(1).alias("kind"), number.alias("number"), F.trim(part(3)).alias("title"), key_of(plain).alias("key")))


def caption_key(text: Column) -> Column:
    """What captions' titles are compared by: letters, digits and ideographs, without the number and bracketed names."""
    return key_of(tx.plain(text))


def key_of(plain: Column) -> Column:
    """``caption_key`` of plain text."""
    bare = F.regexp_replace(plain, r"^[图表]\s*[0-9]+(?:[-.][0-9]+)*[\s\x{3000}、.：:]*", "")
    # several ranges in a negated class take Java ten times as long as a named class
    return F.lower(F.regexp_replace(F.regexp_replace(bare, BRACKETED, ""), r"[^\p{Alnum}\x{4e00}-\x{9fff}]+", ""))


def clean_output(text: Column) -> Column:
    """Without code fences, and with a formula's block once where it stands twice in a row."""
    return F.regexp_replace(trimmed(F.regexp_replace(text, "```(?:html)?", "")), FORMULA_TWICE, "$1")


def without_contents(html: Column) -> Column:
    """Without the links of a table of contents and without empty anchors."""
    return F.regexp_replace(F.regexp_replace(html, CONTENTS_LINK, ""), EMPTY_ANCHOR, "")


def xml_fields(xml: Column) -> Column:
    """The fields of XML of one level as a map; of a repeated one the last."""
    field = F.lit(r"<([^/>]+)>(?:<!\[CDATA\[(.*?)\]\]>|([^<]*))</\1>")
    names, quoted, bare = (F.regexp_extract_all(xml, field, F.lit(i)) for i in (1, 2, 3))
    values = F.zip_with(quoted, bare, lambda a, b: trimmed(F.concat(a, b)))
    own = F.array_distinct(names)
    return F.map_from_arrays(own, F.transform(own, lambda k: F.element_at(values, F.size(names) + 1 - F.array_position(F.reverse(names), k).cast("int"))))


def to_xml(fields: Column) -> Column:
    """A map as XML of one level."""
    inner = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("<"), e["key"], F.lit("><![CDATA["), e["value"], F.lit("]]></"), e["key"], F.lit(">")))
    return F.concat(F.lit("<xml>"), F.array_join(inner, ""), F.lit("</xml>"))


def trailer(content: Column) -> Column:
    """(text, headings): the text before the trailer, and what the trailer lists (null if none or not readable)."""
    at = F.instr(content, TRAILER)
    cut = F.substring(content, F.lit(1), at - 1)
    rest = F.substring(content, at + len(TRAILER), F.length(content))
    return F.struct(F.when(at > 0, cut).otherwise(content).alias("text"), F.when(at > 0, F.from_json(rest, HEADINGS)).alias("headings"))


def images_out(html: Column) -> Column:
    """(text, images): images as numbered placeholders, and the images in order."""
    parts = F.split(html, IMAGE)
    text = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("__IMG_"), (i - 1).cast("string"), F.lit("__"), x))), "")
    return F.struct(text.alias("text"), F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)).alias("images"))


def images_back(text: Column, images: Column) -> Column:
    """The images in place of their placeholders, also where one stands as the source of an image tag; a placeholder without an image stays."""
    text = F.regexp_replace(text, rf"""(?i)<img\b[^>]*\bsrc=["']({PLACEHOLDER.replace("(", "(?:")})["'][^>]*>""", "$1")
    parts, numbers = F.split(text, PLACEHOLDER), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    image = lambda own, n: F.coalesce(F.get(own, n.try_cast("int")), F.concat(F.lit("__IMG_"), n, F.lit("__")))
    # arrays are bound once and zipped: inside a lambda they would be made anew for each placeholder
    written = tx.bound(images, lambda own: F.transform(numbers, lambda n: image(own, n)))
    return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), written), parts, lambda x, rest: F.concat(x, rest)), "")


def table_keys(html: Column) -> Column:
    """What tables are compared by, in order: their text without tags, white space and case."""
    key = lambda t: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>|(?i)&nbsp;", ""), "(?i)&amp;", "&"), r"\s+", ""))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<table\b[\s\S]*?</table>"), F.lit(0)), key)


def alternates(lines: Column) -> Column:
    """Whether the last eight lines with real text are two different ones in turn."""
    # a longer line counts as several, of 300 characters each
    cut = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"[^\n]{30,300}"), F.lit(0))))
    real = F.filter(F.transform(cut, trimmed), lambda x: (F.length(x) >= 30) & x.rlike(r"[\x{4e00}-\x{9fa5}a-zA-Z]{10,}"))
    last = F.slice(real, F.greatest(F.size(real) - 7, F.lit(1)), 8)
    turn = lambda r: F.array_distinct(F.filter(last, lambda _, i: i % 2 == r))
    return (F.size(last) == 8) & (F.size(turn(0)) == 1) & (F.size(turn(1)) == 1) & (F.get(turn(0), F.lit(0)) != F.get(turn(1), F.lit(0)))


def months_back(day: Column, months: int) -> Column:
    """So many months earlier; a day that the month doesn't have runs over into the next."""
    return F.date_add(F.add_months(F.trunc(day, "month"), -months), F.dayofmonth(day) - 1)


def next_nine(ts: Column) -> Column:
    """The next nine o'clock after a time."""
    day = F.when(F.hour(ts) < 9, F.to_date(ts)).otherwise(F.date_add(F.to_date(ts), 1))
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(9))

"""Column rules of laid-out text: lengths of style sheets, spaces of mixed scripts, levels that a paragraph's own text gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.rules import trimmed

#: A number as it begins a length, and one as it stands anywhere before a unit.
LEADING, WITHIN = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", r"([0-9]+(?:\.[0-9]+)?)"
#: Defaults of sizes in points, margins in millimetres, lines in twentieths of a point, indents and fonts.
POINTS, MILLIMETRES, LINE, INDENT, INDENT_CHARS, FONT, COLOR = 12.0, 25.4, 240, 480, 200, "Times New Roman", "000000"
#: Words of units.
POINT_WORDS, LINE_WORD, CHARACTER_WORDS = ("pt", "磅"), "行", ("字符", "ch")
#: Ideographs with full-width marks, and signs that take no spaces.
IDEOGRAPH, SIGNS = r"[\x{4e00}-\x{9fa5}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]", r"[=+\-×÷<>()\[\]{}]"
#: Paragraphs that are headings by their text, in the order in which they are tried.
PARAGRAPHS = [
    (1, r"^第[一二三四五六七八九十百千万0-9]+[章节篇部](?:[^\p{L}\p{N}_]|\z)"),
    (1, r"^[一二三四五六七八九十]+[、．.]\s*[^。；;]{2,}\z"),
    (1, r"^[0-9]+[、．.]\s*[^。；;]{2,}\z"),
    (2, r"^（[一二三四五六七八九十]+）\s*[^。；;]{2,}\z"),
    (2, r"^[0-9]+\.[0-9]+\s+[^。；;]{2,}\z"),
    (3, r"^（[0-9]+）\s*[^。；;]{2,}\z"),
    (3, r"^[0-9]+\.[0-9]+\.[0-9]+\s+[^。；;]{2,}\z"),
]
#: The longest paragraph that can be a heading, and the name of a heading's style.
LONGEST, STYLE = 90, r"(?i)(?:Heading|标题)\s*([0-9]+)"


def number(text: Column, pattern: str = LEADING) -> Column:
    """The number that a pattern finds; null if there is none."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def names(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a length names one of some units."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def points(size: Column) -> Column:
    """A font size in points."""
    return F.coalesce(number(size, WITHIN), F.lit(POINTS))


def spacing(length: Column, size: Column) -> Column:
    """Space between paragraphs in twentieths of a point; lines, and what has no unit, go by the font size."""
    value = number(length)
    exact = names(length, POINT_WORDS) & ~length.contains(LINE_WORD)
    return F.coalesce(rounded(F.when(exact, value * 20).otherwise(value * size * 30)), F.lit(0).cast("long"))


def line_height(height: Column) -> Column:
    """(line, exact): a line's height in twentieths of a point, or in 240ths of a line."""
    value, exact = number(height), F.coalesce(names(F.lower(height), POINT_WORDS), F.lit(False))
    line = F.coalesce(rounded(F.when(exact, value * 20).otherwise(value * 240)), F.lit(LINE).cast("long"))
    return F.struct(line.alias("line"), (exact & value.isNotNull()).alias("exact"))


def indent(length: Column, size: Column) -> Column:
    """(first_line, chars): a first line's indent in twentieths of a point and in hundredths of a character; null for none."""
    em, pt, begun = number(length, WITHIN + "em"), number(length, WITHIN + "pt"), number(length)
    of = lambda line, chars: F.struct(line.cast("long").alias("first_line"), chars.cast("long").alias("chars"))
    by_chars = lambda n: of(rounded(n * size * 20), rounded(n * 100))
    given = F.when(em.isNotNull(), by_chars(em)).when(pt.isNotNull(), of(rounded(pt * 20), F.lit(None)))
    given = given.when(names(length, CHARACTER_WORDS), by_chars(F.coalesce(F.nullif(begun, F.lit(0.0)), F.lit(2.0))))
    return F.when(~length.isin("", "0", "0px"), given.otherwise(of(F.lit(INDENT), F.lit(INDENT_CHARS))))


def millimetres(length: Column) -> Column:
    """A margin in millimetres, which is also the unit of a bare number."""
    found = r"(?i)([0-9.]+)\s*(cm|mm|in)?"
    value = F.regexp_extract(F.regexp_extract(length, found, 1), r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(length, found, 2))
    return F.coalesce(value * F.when(unit == "cm", 10.0).when(unit == "in", 25.4).otherwise(1.0), F.lit(MILLIMETRES))


def font(family: Column) -> Column:
    """The first font of a list, a quoted one before others."""
    quoted = F.regexp_extract(family, r"""["']([^"']+)["']""", 1)
    first = F.regexp_replace(trimmed(F.substring_index(family, ",", 1)), "[\"']", "")
    return F.when(family.isNull() | (family == ""), FONT).when(quoted != "", quoted).otherwise(first)


def color(value: Column) -> Column:
    """A color without its sign; none is black."""
    return F.when(value.isNull() | (value == ""), COLOR).otherwise(F.regexp_replace(value, "^#", ""))


def closed_up(text: Column) -> Column:
    """White space as single spaces, and none beside ideographs, full-width marks and signs."""
    single = F.regexp_replace(text, r"[\n\r\t\x0B\f \x{A0}\x{3000}]+", " ")
    beside = F.regexp_replace(single, rf"(?<={IDEOGRAPH}) (?=\S)|(?<=\S) (?={IDEOGRAPH})", "")
    return F.regexp_replace(beside, rf" ?({SIGNS}) ?", "$1")


def paragraph_level(text: Column, style: Column, outline: Column) -> Column:
    """A paragraph's level as a heading: by its style, else by its outline level (from 0), else by its text; null for none."""
    styled = F.regexp_extract(style, STYLE, 1).try_cast("int")
    own = trimmed(text)
    found = F.coalesce(*(F.when(own.rlike(pattern), level) for level, pattern in PARAGRAPHS))
    return F.coalesce(F.when(styled.between(1, 9), styled), outline.cast("int") + 1, F.when(F.length(own).between(1, LONGEST), found))

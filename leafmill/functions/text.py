"""Text and HTML scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers see it; the class is written so that other engines' dialects read it alike.
SPACE = r"[ \t\n\r\f\x0B\x{A0}\x{3000}\x{FEFF}]"
#: Characters of Chinese numerals, and titles of front and back matter.
NUMERAL = "一二三四五六七八九十百零"
LEADING = "目录 目次 contents tableofcontents 摘要 中文摘要 英文摘要 内容摘要 abstract 关键词 keywords 前言 序言 序 preface foreword 声明 原创性声明 版权声明".split()
TRAILING = "致谢 致谢辞 acknowledgement acknowledgements acknowledgments".split()
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once; lambdas in ``use`` would make it anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeezed(text: Column) -> Column:
    """Tags become spaces, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), f"{SPACE}+", " "))


def compact(text: Column) -> Column:
    """Neither tags nor white space."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), f"{SPACE}+", "")


def decoded(text: Column) -> Column:
    """The basic entities as characters, one after the other, in letters of either case."""
    return reduce(lambda t, kv: F.regexp_replace(t, f"(?i){kv[0]}", kv[1]), ENTITIES.items(), text)


def plain(html: Column) -> Column:
    """The visible text of HTML."""
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.when(F.contains(html, F.lit("&")), decoded(bare)).otherwise(bare), f"{SPACE}+", " "))


def audited(html: Column) -> Column:
    """Visible text without scripts and styles."""
    return squeezed(F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "))


NUMBER = rf"(?:第[{NUMERAL}0-9]+[章节篇部回]|[{NUMERAL}]+[、.]|[(（][{NUMERAL}0-9]+[)）]|[0-9]+(?:\.[0-9]+)*(?:[.、]|(?={SPACE})))"
#: A number before a heading, if more than tags and white space is behind it. What it takes is settled before that is asked.
PREFIX = rf"^(?>((?:<(?:strong|b|span|em)[^>]*>)?){SPACE}*{NUMBER}{SPACE}*)(?=(?:<[^>]*>|{SPACE}++)*+[\s\S])"


def without_number(heading: Column) -> Column:
    """A heading without its number; up to four prefixes go, but never all of the text."""
    for _ in range(4):  # each step names the one before once: named three times, the first would be made 27 times in a lambda
        heading = F.regexp_replace(heading, PREFIX, "$1")
    return heading


def heading_norm(heading: Column) -> Column:
    """A heading without tags, number and white space: what titles are compared by."""
    return compact(without_number(F.regexp_replace(heading, "<[^>]*>", "")))


def heading_key(heading: Column) -> Column:
    """A heading as ``heading_norm`` has it, in small letters."""
    return F.lower(compact(without_number(heading)))


def is_front_matter(heading: Column) -> Column:
    return heading_key(heading).isin(LEADING)


def is_back_matter(heading: Column) -> Column:
    return heading_key(heading).isin(TRAILING)


def is_matter(norm: Column) -> Column:
    """Whether a heading, as ``heading_norm`` has it, is of front or back matter."""
    return F.lower(norm).isin(LEADING + TRAILING)


def chinese(n: Column) -> Column:
    """1 to 99 as a Chinese numeral; other numbers as digits."""
    digit = lambda d: F.substring(F.lit("一二三四五六七八九"), d.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    written = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    return F.when(n.between(1, 99), written).otherwise(n.cast("string"))


def numbered(counters: Column, scheme: str) -> Column:
    """The number of a heading from its counters (array, one for each level down to its own)."""
    last, depth, dotted = F.element_at(counters, -1), F.size(counters), F.array_join(counters.cast("array<string>"), ".")
    if scheme == "chinese-hierarchical":
        return F.when(depth == 1, F.concat(chinese(last), F.lit("、"))).when(depth == 2, F.concat(F.lit("（"), chinese(last), F.lit("）"))).when(depth == 3, F.concat(last.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("("), last.cast("string"), F.lit(")")))
    if scheme == "chapter":
        below = F.array_join(F.slice(counters, 3, F.greatest(depth - 2, F.lit(1))).cast("array<string>"), ".")
        return F.when(depth == 1, F.concat(F.lit("第"), chinese(last), F.lit("章"))).when(depth == 2, F.concat(F.lit("第"), chinese(last), F.lit("节"))).when(depth == 3, F.concat(chinese(last), F.lit("、"))).otherwise(below)
    if scheme in ("decimal", "decimal-nested"):
        return F.when(depth == 1, F.concat(dotted, F.lit("."))).otherwise(dotted)
    return F.lit("")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def distance(a: str, b: str) -> int:
    """The edit distance of two texts, a row of its table at once as the bits of a number."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, fewer, n = every, 0, len(a)  # where a row of the table rises and falls
    for y in b:
        same = places.get(y, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = fewer | every & ~(across | more), more & across
        n += bool(up & last) - bool(down & last)
        up, down, same = up << 1 | 1, down << 1, same | fewer
        more, fewer = (down | ~(same | up)) & every, up & same & every
    return n


def overlap(left: str, right: str, least: int = 80, window: int = 2600) -> int:
    """The length of the longest end of ``left`` that begins ``right``, 0 below ``least``."""
    left, right = left[-window:], right[:window]
    head = right[: max(least, 1)]
    at = left.find(head) if len(head) >= least and head else -1
    while at >= 0 and not right.startswith(left[at:]):
        at = left.find(head, at + 1)
    return len(left) - at if at >= 0 else 0


#: Other names of presets.
PRESETS = ["academic", "academic-journal", "corporate", "work-report", "meeting-minutes", "creative"]


def preset(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A preset's name in its usual form; unknown ones are the first."""
    key = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))
    for a, b in (aliases or {}).items():
        key = F.when(key == a, b).otherwise(key)
    return F.when(key.isin(PRESETS), key).otherwise(PRESETS[0])


def masked_phone(phone: Column) -> Column:
    return F.concat(F.substring(phone, 1, 3), F.lit("****"), F.right(phone, F.lit(4)))


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_mobile(text: Column) -> Column:
    return F.coalesce(text.rlike("^1[3-9][0-9]{9}$"), F.lit(False))


def classified(text: Column, rules: dict[str, list[str]], other: str) -> Column:
    """The first rule one of whose words the text holds."""
    out = F.lit(other)
    for name, words in reversed(rules.items()):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), name).otherwise(out)
    return out


def token_estimate(n_in: Column, n_out: Column) -> Column:
    return (F.ceil(n_in / 3) + F.ceil(n_out / 3)).cast("long")

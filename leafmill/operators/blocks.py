"""HTML documents as tables of blocks, and the rules that settle titles, headings, captions and images of a rewritten document.

``split`` cuts a document into headings, paragraphs and captions with the text
between them; the steps change rows by ordered windows and folds; ``splice`` puts
the rows together again. One shuffle by the document's key serves all windows.
``post_processed`` runs the steps in their order, twice with the same result.
"""

from __future__ import annotations

from bisect import bisect_left
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import outlines as rules
from leafmill.functions import text as tx
from leafmill.operators import documents

#: What a block is: a heading, a paragraph or a caption.
BLOCK = r'(?is)<h([1-6])\b[^>]*>.*?</h\1>|<p\b[^>]*>.*?</p>|<div\b[^>]*\bclass="[^"]*\b(?:figure-caption|table-caption)\b[^"]*"[^>]*>.*?</div>'
#: Lines of a cover that name the type of document.
TYPE_LINES = "研究报告 报告 毕业论文 学位论文 本科毕业论文 硕士学位论文 博士学位论文 可行性研究报告 设计方案 项目报告 工作报告 调研报告 实施方案 申报书 申报指南".split()
#: Fixed value: the line before images that have lost their place.
IMAGES_LOST = "<p><strong>附录:未能在正文中定位的图片</strong></p>"
#: Numbering schemes that write a number.
SCHEMES = ("decimal", "decimal-nested", "chinese-hierarchical", "chapter")
KINDS = {"figure": "图", "table": "表"}
NO_NODE = "struct<id:string,level:int,number:string,norm:string>"


def split(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, pos, gap, block, kind, level, attrs, inner): the blocks in order, each with the text before it.

    The last row of a document has no block; a null document has that row alone, with a null gap.
    """
    whole = F.arrays_zip(F.split(html, BLOCK, -1).alias("gap"), F.regexp_extract_all(html, F.lit(BLOCK), F.lit(0)).alias("block"))
    rows = pages.select(key, F.posexplode_outer(whole).alias("pos", "b")).select(key, F.coalesce("pos", F.lit(0)).alias("pos"), "b.gap", "b.block")
    name = F.lower(F.regexp_extract("block", "^<([a-zA-Z]+)", 1))
    attrs = F.regexp_extract("block", r"^<[a-zA-Z]+[1-6]?([^>]*)>", 1)
    kind = F.when(name == "h", "heading").when(name == "p", "paragraph").when(name == "div", F.when(attrs.rlike("(?i)figure-caption"), "figure").otherwise("table"))
    level = F.when(name == "h", F.substring("block", 3, 1).cast("int"))
    inner = F.regexp_extract("block", r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
    return rows.select(key, "pos", "gap", "block", kind.alias("kind"), level.alias("level"), attrs.alias("attrs"), inner.alias("inner"))


def splice(blocks: DataFrame, key: str = "doc_id", *carried: str) -> DataFrame:
    """(key, html, carried): the documents again; a row whose ``kind`` is ``gone`` leaves its gap. ``carried`` columns are one value a document."""
    level = F.col("level").cast("string")
    made = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, "attrs", F.lit(">"), "inner", F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind").isin(*KINDS), F.concat(F.lit("<div"), "attrs", F.lit(">"), "inner", F.lit("</div>")))
        .when(F.col("kind") == "gone", "")
        .otherwise(F.coalesce("block", F.lit("")))
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat("gap", made).alias("text"))))
    # a null document has one row, whose null text the join would leave out
    text = F.when(F.count("gap") > 0, F.array_join(F.transform(parts, lambda x: x["text"]), ""))
    return blocks.groupBy(key).agg(text.alias("html"), *(F.first(c).alias(c) for c in carried))


def has_class(attrs: Column, name: str) -> Column:
    """Whether a tag's class attribute names a class."""
    own = F.split(F.lower(F.regexp_extract(attrs, r'(?i)\bclass\s*=\s*"([^"]*)"', 1)), r"\s+")
    return F.array_contains(own, name)


def without_class(attrs: Column, name: str) -> Column:
    """The attributes without one class; a class attribute left empty goes."""
    own = F.regexp_extract(attrs, r'(?i)\bclass\s*=\s*"([^"]*)"', 1)
    left = F.array_join(F.filter(F.split(own, r"\s+"), lambda c: (c != "") & (F.lower(c) != name)), " ")
    parts = F.split(attrs, r'(?i)\s*class\s*=\s*"[^"]*"', 2)
    kept = F.when(left != "", F.concat(F.lit(' class="'), left, F.lit('"'))).otherwise("")
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), kept, F.get(parts, F.lit(1)))).otherwise(attrs)


def one_title(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first heading of level 1 is the title (column ``title``, as titles are compared; empty if none).

    Later ones that repeat it go, and with them a line right below that only names
    the type of document; others of level 1 become level 2 and are no titles.
    """
    order = Window.partitionBy(key).orderBy("pos")
    rows = blocks.withColumn("norm", F.when(F.col("kind") == "heading", tx.heading_norm(F.col("inner"))))
    top = F.coalesce((F.col("kind") == "heading") & (F.col("level") == 1), F.lit(False))
    first = F.first(F.when(top, F.struct("pos", "norm")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("first", first).withColumn("later", top & (F.col("pos") > F.col("first.pos")))
    rows = rows.withColumn("again", F.col("later") & (F.col("norm") != "") & (F.col("norm") == F.col("first.norm")))
    plain = F.regexp_replace(F.regexp_replace("inner", "<[^>]*>", ""), f"{tx.SPACE}+", "")
    line = (F.col("kind") == "paragraph") & F.lag("again").over(order) & F.col("gap").rlike(r"^\s*$") & plain.isin(TYPE_LINES)
    line = F.coalesce(line, F.lit(False))
    return rows.withColumn("line", line).select(
        # only paragraphs are written as they came; the others' blocks would be sorted and shuffled for nothing
        key, "pos", F.when(F.col("line"), "").otherwise(F.col("gap")).alias("gap"), F.when(F.col("kind") == "paragraph", F.col("block")).alias("block"),
        F.when(F.coalesce("again", F.lit(False)) | F.col("line"), "gone").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("later"), 2).otherwise(F.col("level")).alias("level"),
        F.when(F.col("later"), without_class(F.col("attrs"), "doc-title")).otherwise(F.col("attrs")).alias("attrs"),
        "inner", "norm", F.coalesce("first.norm", F.lit("")).alias("title"),
    )


def body_heading(least: int = 2) -> Column:
    """Whether a row is a heading of the body: not the title, not the title in another language."""
    return F.coalesce((F.col("kind") == "heading") & (F.col("level") >= least) & ~has_class(F.col("attrs"), "doc-title-en"), F.lit(False))


def to_skeleton(blocks: DataFrame, skeletons: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Headings take the level of the outline's node that they match; others of level 2 go one down.

    ``skeletons`` is (key, nodes array of (id, level, number, norm)), one row a document.
    Returns the rows, with the matched ``node``, and (key, demoted, missing, missing_chapters, chapters).
    Documents without an outline stay as they are.
    """
    outline = skeletons.where(F.size("nodes") > 0)
    rows = blocks.withColumn("attrs", F.when(F.col("kind") == "heading", F.regexp_replace("attrs", r'(?i)\s*data-sk="[^"]*"', "")).otherwise(F.col("attrs")))
    found = F.array_sort(F.collect_list(F.when(body_heading(), F.struct("pos", "norm"))))
    per_doc = rows.groupBy(key).agg(F.first("title").alias("title"), found.alias("found")).join(outline, key)
    # the title takes the outline's node of its own, if there is one
    asked = per_doc.select(
        F.col(key).alias("doc_id"), "nodes", "found", F.transform("nodes", lambda n: n["norm"]).alias("outline"), F.concat(F.array("title"), F.transform("found", lambda f: f["norm"])).alias("norms")
    )
    matched = documents.aligned_rows(asked, "outline", "norms", "matches")
    pairs = F.arrays_zip(F.transform("found", lambda f: f["pos"]).alias("pos"), F.slice("matches", 2, F.greatest(F.size("found"), F.lit(1))).alias("at"))
    placed = matched.select(F.col("doc_id").alias(key), "nodes", F.explode(pairs).alias("m")).select(key, F.col("m.pos").alias("pos"), F.get("nodes", F.col("m.at")).alias("node"))
    joined = rows.join(outline.select(key, F.lit(True).alias("has_outline")), key, "left").join(placed, [key, "pos"], "left")
    demoted = F.coalesce(body_heading() & F.col("has_outline") & F.col("node").isNull() & (F.col("level") == 2), F.lit(False))
    joined = joined.withColumn("demoted", demoted)
    level = F.when(F.col("node").isNotNull(), F.col("node.level")).when(F.col("demoted"), 3).otherwise(F.col("level"))
    unused = F.filter("nodes", lambda n, i: ~F.array_contains(F.col("matches"), i))
    chapter = lambda n: (n["level"] == 2) & ~tx.is_matter(n["norm"])
    counted = matched.select(
        F.col("doc_id").alias(key), F.size(unused).alias("missing"), F.size(F.filter(unused, chapter)).alias("missing_chapters"), F.size(F.filter("nodes", chapter)).alias("chapters")
    )
    lowered = joined.groupBy(key).agg(F.count_if("demoted").alias("demoted"))
    return joined.withColumn("level", level).drop("demoted"), counted.join(lowered, key)


def promoted(blocks: DataFrame, captions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs that are captions of the source become captions.

    ``captions`` is (key, figures, tables): arrays of (kind, number, title, key, text), as ``source_captions`` gives.
    """
    c = rules.caption(F.col("inner"))
    rows = blocks.join(captions, key, "left").withColumn("c", F.when(F.col("kind") == "paragraph", c))
    own = F.when(F.col("c.kind") == KINDS["figure"], F.col("figures")).otherwise(F.col("tables"))
    known = F.coalesce(F.exists(own, lambda e: caption_score(F.col("c"), e) >= threshold(e)), F.lit(False)) & F.col("c").isNotNull()
    rows = rows.withColumn("known", known)
    kind = F.when(F.col("known"), F.when(F.col("c.kind") == KINDS["figure"], "figure").otherwise("table")).otherwise(F.col("kind"))
    attrs = F.when(F.col("known"), F.concat(F.lit(' class="'), kind, F.lit('-caption"'))).otherwise(F.col("attrs"))
    inner = F.when(F.col("known"), tx.plain(F.col("inner"))).otherwise(F.col("inner"))
    return rows.select(*(c for c in blocks.columns if c not in ("kind", "attrs", "inner")), kind.alias("kind"), attrs.alias("attrs"), inner.alias("inner"))


def numbered(blocks: DataFrame, scheme: str, figure_relative: bool = False, table_relative: bool = False, keep_source_numbers: bool = False, key: str = "doc_id") -> DataFrame:
    """Headings of level 2 and below, and captions, numbered in order.

    Not numbered, and not counted: front matter before the first chapter, back
    matter, headings before the first chapter; those that repeat the title go. A
    caption counts within its chapter or over the document; where the document has
    an outline, a caption that has a number keeps it.
    """
    order = Window.partitionBy(key).orderBy("pos")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    again = body_heading() & (F.col("title") != "") & (F.col("norm") == F.col("title"))
    rows = blocks.withColumn("kind", F.when(again, "gone").otherwise(F.col("kind")))
    key_of = F.lower(F.col("norm"))
    chapter = body_heading() & (F.col("level") == 2) & ~key_of.isin(tx.LEADING) & ~key_of.isin(tx.TRAILING)
    begun = F.coalesce(F.max(chapter).over(before), F.lit(False))
    matter = (key_of.isin(tx.LEADING) & ~begun) | key_of.isin(tx.TRAILING)
    rows = rows.withColumn("matter", body_heading() & matter).withColumn("counts", body_heading() & ~matter)
    # all counters go by one order, so that rows are sorted once: those of a document less those where one above counted last
    nth = lambda flag: F.count(F.when(flag, 1)).over(so_far)
    since = lambda n, flag: F.col(n) - F.coalesce(F.last(F.when(flag, F.col(n)), ignorenulls=True).over(so_far), F.lit(0))
    counted = lambda *levels: F.col("counts") & F.col("level").isin(*levels)
    names = [f"c{depth}" for depth in range(1, 6)]
    rows = rows.withColumns({c: nth(counted(depth + 1)) for depth, c in enumerate(names, 1)})
    rows = rows.withColumns({c: since(c, counted(*range(2, depth + 1))) for depth, c in enumerate(names[1:], 2)})
    counters = F.slice(F.array(*names), F.lit(1), F.greatest(F.col("level") - 1, F.lit(1)))
    number = tx.numbered(counters, scheme)
    if keep_source_numbers:
        source = F.col("node.number")
        number = F.when(source != "", rules.source_number(source, scheme)).otherwise(number)
    bare = F.regexp_replace(tx.without_number(F.col("inner")), r"^\s+", "")
    unnumbered = F.col("matter") | (F.col("counts") & (F.col("level") > 2) & (F.col("c1") == 0) & F.lit(scheme in SCHEMES))
    heading = F.when(unnumbered, bare).when(F.col("counts") & F.lit(scheme in SCHEMES), F.concat(number, F.lit(" "), bare))
    relative = (F.col("kind") == "figure") & F.lit(figure_relative) | (F.col("kind") == "table") & F.lit(table_relative)
    sign = F.when(F.col("kind") == "figure", KINDS["figure"]).otherwise(KINDS["table"])
    has_number = F.regexp_replace(F.col("inner"), "<[^>]+>", "").rlike(r"^\s*[图表]\s*[0-9]+(?:[-.][0-9]+)*\b") & F.ltrim(F.regexp_replace("inner", "<[^>]+>", "")).startswith(sign)
    rows = rows.withColumn("heading", heading).withColumn("keeps", F.coalesce(F.col("has_outline") & has_number, F.lit(False)))
    rows = rows.withColumn("within", F.col("kind").isin(*KINDS) & ~F.col("keeps") & relative & (F.col("c1") > 0))
    rows = rows.withColumn("overall", F.col("kind").isin(*KINDS) & ~F.col("keeps") & ~F.col("within"))
    flags = {f"{flag}_{kind}": F.col(flag) & (F.col("kind") == kind) for flag in ("within", "overall") for kind in KINDS}
    rows = rows.withColumns({name: nth(flag) for name, flag in flags.items()})
    rows = rows.withColumns({name: since(name, counted(2)) for name in flags if name.startswith("within")})
    own = lambda flag: F.when(F.col("kind") == "figure", F.col(f"{flag}_figure")).otherwise(F.col(f"{flag}_table")).cast("string")
    n = F.when(F.col("within"), F.concat(F.col("c1").cast("string"), F.lit("-"), own("within"))).otherwise(own("overall"))
    tag = r"^(\s*(?:<(?:strong|b|span|em)\b[^>]*>\s*)?)"
    title = F.regexp_replace("inner", rf"(?i){tag}[图表]\s*[0-9]+(?:[-.][0-9]+)*[\s\x{{3000}}、.:]*", "$1")
    title = F.when(F.regexp_replace("inner", rf"(?i){tag}", "").startswith(sign), title).otherwise(F.col("inner"))
    kept = F.regexp_replace("inner", rf"(?i)^(\s*(?:<(?:strong|b|span|em)\b[^>]*>\s*)?[图表]\s*[0-9]+(?:[-.][0-9]+)*\s+)(?:Figure|Table)\s+[0-9]+(?:[-.][0-9]+)*\s*", "$1")
    ltrim = lambda c: F.regexp_replace(c, r"^\s+", "")
    caption = F.when(F.col("keeps"), ltrim(kept)).otherwise(F.concat(sign, n, F.lit(" "), ltrim(title)))
    inner = F.when(F.col("heading").isNotNull(), F.col("heading")).when(F.col("kind").isin(*KINDS), caption).otherwise(F.col("inner"))
    return rows.withColumn("inner", inner).select(blocks.columns)


def caption_score(candidate: Column, expected: Column) -> Column:
    """How well a caption (number, key) fits an expected one: its number, and its title by equality, containment or edit distance."""
    ct, et = candidate["key"], expected["key"]
    same_prefix = F.when((candidate["kind"] == expected["kind"]) & (candidate["number"] == expected["number"]), 12).otherwise(0)
    alike = tx.similarity(ct, et)
    title = (
        F.when(et == "", F.when(ct == "", 16).otherwise(-6))
        .when(ct == "", F.lit(-8))
        .when(ct == et, 30)
        .when((F.length(ct) >= 3) & (F.length(et) >= 3) & (F.contains(ct, et) | F.contains(et, ct)), 18)
        .when(alike >= 0.72, F.floor(alike * 14 + 0.5).cast("int"))
        .otherwise(0)
    )
    # a bare number for an empty title counts once: -6 stands against the prefix, -8 likewise
    return same_prefix + title


def threshold(expected: Column) -> Column:
    return F.when(expected["key"] != "", 14).otherwise(10)


def source_captions(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, figures, tables): the captions of the source in order, as arrays of (kind, number, title, key, text)."""
    pattern = r"(?is)<(p|div|caption)\b[^>]*>(.*?)</\1>"
    inner = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    # first the texts, then what they say: in one lambda each part of a caption would make its text anew
    parsed = F.filter(F.transform(F.transform(inner, tx.plain), lambda t: F.struct(rules.caption_of(t).alias("c"), t.alias("text"))), lambda x: x["c"].isNotNull())
    flat = F.transform(parsed, lambda x: F.struct(x["c"]["kind"].alias("kind"), x["c"]["number"].alias("number"), x["c"]["title"].alias("title"), x["c"]["key"].alias("key"), x["text"].alias("text")))
    rows = pages.select(key, flat.alias("all"))
    of_kind = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    return rows.select(key, *(of_kind(kind).alias(f"{name}s") for name, kind in KINDS.items()))


def matched_captions(outputs: Column, expected: Column, by_output: bool = False) -> Column:
    """For each expected caption the number of the output that fits it best from behind the last match on, or -1.

    A fold over the expected ones: an output further on loses 0.2 a place, at most 8; of equal ones the first counts.
    ``by_output`` gives for each output the number of the expected one that it fits, or -1.
    """

    @F.pandas_udf("array<int>")
    def picks(prefixes: pd.Series, keys: pd.Series, own_prefixes: pd.Series, own_keys: pd.Series) -> pd.Series:
        found = [(len(a), fitted(list(zip(a, b)), list(zip(c, d)))) for a, b, c, d in zip(prefixes, keys, own_prefixes, own_keys)]
        return pd.Series([turned(own, n) if by_output else own for n, own in found], dtype=object)

    prefix = lambda of: F.transform(of, lambda c: F.concat(c["kind"], F.lit(" "), c["number"]))
    key = lambda of: F.transform(of, lambda c: c["key"])
    return picks(prefix(outputs), key(outputs), prefix(expected), key(expected))


def turned(picks: list[int], n: int) -> list[int]:
    """For each of ``n`` outputs the number of the pick that names it, or -1."""
    out = [-1] * n
    for i, at in enumerate(picks):
        if at >= 0:
            out[at] = i
    return out


#: Places from the last match on within which a title may do without an equal number or key: 18 less 0.2 a place is under 14 beyond.
NEAR = 21


def fitted(outputs: list[tuple[str, str]], expected: list[tuple[str, str]]) -> list[int]:
    """``matched_captions`` of one document, of (kind and number, key) each.

    Only captions of the same number or key, of the latter the first, can reach the
    threshold anywhere; within ``NEAR`` places those that hold the title or are in
    it; and the next one: no others are looked at.
    """
    keys = [key for _, key in outputs]
    by_prefix: dict[str, list[int]] = {}
    by_key: dict[str, list[int]] = {}
    for i, (prefix, key) in enumerate(outputs):
        by_prefix.setdefault(prefix, []).append(i)
        by_key.setdefault(key, []).append(i)
    cursor, out = 0, []
    for prefix, key in expected:
        same, equal = by_prefix.get(prefix, []), by_key.get(key, [])
        at = bisect_left(equal, cursor)
        places = {*range(cursor, min(cursor + 1, len(outputs))), *same[bisect_left(same, cursor) :], *equal[at : at + 1]}
        if key:
            places.update(i for i, k in enumerate(keys[cursor : cursor + NEAR], cursor) if key in k or k in key)
        best, pick = max(((score(outputs[i], (prefix, key), i == cursor) - min(8.0, (i - cursor) * 0.2), -i) for i in places), default=(0.0, 1))
        out.append(-pick if best >= (14 if key else 10) else -1)
        cursor = max(cursor, out[-1] + 1)
    return out


def score(candidate: tuple[str, str], expected: tuple[str, str], first: bool) -> int:
    """``caption_score`` as far as it can reach the threshold: likeness alone does so at the first place only."""
    ct, et, same = candidate[1], expected[1], candidate[0] == expected[0]
    if not et or not ct:
        title = (-8 if et else -6) if ct or et else 16
    elif ct == et:
        title = 30
    elif len(ct) >= 3 and len(et) >= 3 and (et in ct or ct in et):
        title = 18
    elif same or first and akin(ct, et, max(len(ct), len(et)) // 28):  # without the same number, only 27 of 28 parts alike give 14
        alike = 1 - tx.distance(ct, et) / max(len(ct), len(et))
        title = floor(alike * 14 + 0.5) if alike >= 0.72 else 0
    else:
        title = 0
    return 12 * same + title


def akin(a: str, b: str, n: int) -> bool:
    """Whether two texts may be ``n`` edits apart: of n + 1 pieces of the one, one at least is then in the other."""
    size = len(a) // (n + 1)
    return abs(len(a) - len(b)) <= n and any(a[i * size : (i + 1) * size] in b for i in range(n + 1))


def to_captions(blocks: DataFrame, captions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Captions of the source's text where they match the source's, gone where they don't; with ``caption`` (pruned, missing).

    Documents whose source has no captions stay as they are, their ``caption`` is null. A document's rows are gathered,
    matched and laid out again: joined by their places, rows and captions would be made anew for each join.
    """
    parsed = rules.caption(F.col("inner"))
    other = F.struct(F.lit("").alias("kind"), F.lit("").alias("number"), F.lit("").alias("title"), rules.caption_key(F.col("inner")).alias("key"))
    is_caption = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    own = [c for c in blocks.columns if c != key]
    # captions are written from their parts, so that their blocks needn't be gathered
    fields = {c: F.when(~is_caption, F.col(c)) if c == "block" else F.col(c) for c in ["pos", *own]} | {"c": F.when(is_caption, F.coalesce(parsed, other))}
    rows = F.array_sort(F.collect_list(F.struct(*(x.alias(c) for c, x in fields.items()))))
    per_doc = blocks.groupBy(key).agg(rows.alias("rows")).join(captions, key, "left")
    per_doc = per_doc.withColumns({f"{name}s": F.coalesce(f"{name}s", F.array()) for name in KINDS} | {name: F.filter("rows", lambda r: r["kind"] == name) for name in KINDS})
    per_doc = per_doc.withColumns({f"{name}_picks": matched_captions(F.transform(name, lambda r: r["c"]), F.col(f"{name}s"), by_output=True) for name in KINDS})
    total = lambda of: sum((F.size(of(name)) for name in KINDS), F.lit(0))
    matched = total(lambda name: F.filter(f"{name}_picks", lambda p: p >= 0))
    known = total(lambda name: F.col(f"{name}s")) > 0
    counted = F.when(known, F.struct((total(F.col) - matched).alias("pruned"), (total(lambda name: F.col(f"{name}s")) - matched).alias("missing")))

    def placed(name: str) -> Column:
        """Each caption of the output and the text of that of the source, null if none fits."""
        zipped = F.arrays_zip(F.col(name).alias("row"), F.col(f"{name}_picks").alias("at"))
        return F.transform(zipped, lambda x: F.struct(x["row"].alias("row"), F.get(f"{name}s", x["at"])["text"].alias("expected")))

    others = F.transform(F.filter("rows", lambda r: r["c"].isNull()), lambda r: F.struct(r.alias("row"), F.lit(None).cast("string").alias("expected")))
    # outer, so that no filter makes the array a second time: no document is without rows
    done = per_doc.select(key, counted.alias("caption"), F.explode_outer(F.concat(others, *map(placed, KINDS))).alias("x"))
    gone = F.col("caption").isNotNull() & F.col("x.row.c").isNotNull() & F.col("x.expected").isNull()
    changed = {"kind": F.when(gone, "gone").otherwise(F.col("x.row.kind")), "inner": F.coalesce("x.expected", "x.row.inner")}
    return done.select(key, *(changed.get(c, F.col(f"x.row.{c}")).alias(c) for c in own), "caption")


def settled_images(html: Column, expected: Column) -> Column:
    """(text, stray, missing, duplicated): each expected placeholder once, lost ones at the end; without any expected, image tags go."""
    token = "__IMG_[0-9]+__"
    stray = F.regexp_count(html, F.lit(r"(?i)<img\b[^>]*>"))
    parts, tokens = F.split(html, token, -1), F.regexp_extract_all(html, F.lit(token), F.lit(0))
    stays = lambda every, t, i: (F.array_position(every, t) == i + 1) | ~F.array_contains(expected, t)
    kept = tx.bound(tokens, lambda every: F.transform(every, lambda t, i: F.when(stays(every, t, i), t).otherwise("")))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    missing = F.array_except(expected, tokens)
    tail = F.when(F.size(missing) > 0, F.concat(F.lit(IMAGES_LOST + "<p>"), F.array_join(missing, "</p><p>"), F.lit("</p>"))).otherwise("")
    twice = tx.bound(tokens, lambda every: F.size(F.filter(expected, lambda e: F.size(F.filter(every, lambda t: t == e)) > 1)))
    none = F.coalesce(F.size(expected) == 0, F.lit(True))
    zero = F.lit(0)
    return F.struct(
        F.when(none, F.regexp_replace(html, r"(?i)<img\b[^>]*>", "")).otherwise(F.concat(joined, tail)).alias("text"),
        F.when(none, stray).otherwise(zero).alias("stray"), F.when(none, zero).otherwise(F.size(missing)).alias("missing"), F.when(none, zero).otherwise(twice).alias("duplicated"),
    )


def post_processed(
    pages: DataFrame, scheme: str, skeletons: DataFrame | None = None, captions: DataFrame | None = None, figure_relative: bool = False, table_relative: bool = False, keep_source_numbers: bool = False, key: str = "doc_id", html: str = "html", images: str | None = None
) -> DataFrame:
    """(key, html, issues): all steps in their order: title, outline, captions promoted, numbers, captions of the source, images.

    ``images`` names a column of expected placeholders. An issue is (type, severity, n). Null documents stay null, without issues.
    """
    rows = one_title(split(pages, key, html), key).withColumns({"has_outline": F.lit(None).cast("boolean"), "node": F.lit(None).cast(NO_NODE)})
    issues: list[Column] = []
    counts: list[DataFrame] = []
    issue = lambda bad, name, severity, n: F.when(bad, F.struct(F.lit(name).alias("type"), severity.alias("severity"), n.cast("long").alias("n")))
    if skeletons is not None:
        rows, found = to_skeleton(rows.drop("has_outline", "node"), skeletons, key)
        counts.append(found.select(key, F.struct("demoted", "missing", "missing_chapters", "chapters").alias("outline")))
        many = F.col("outline.missing_chapters") > F.greatest(F.lit(1), F.ceil(F.col("outline.chapters") * 0.15))
        issues.append(issue(F.col("outline.demoted") > 0, "heading_demoted", F.lit("info"), F.col("outline.demoted")))
        issues.append(issue(F.col("outline.missing") > 0, "heading_missing", F.when(many, "critical").otherwise("warning"), F.col("outline.missing")))
    if captions is not None:
        rows = promoted(rows, captions, key)
    rows = numbered(rows, scheme, figure_relative, table_relative, keep_source_numbers, key)
    if captions is not None:
        rows = to_captions(rows, captions, key)
        issues.append(issue(F.col("caption.pruned") > 0, "caption_pruned", F.lit("info"), F.col("caption.pruned")))
        issues.append(issue(F.col("caption.missing") > 0, "caption_missing", F.lit("warning"), F.col("caption.missing")))
    done = splice(rows, key, *(["caption"] if captions is not None else []))
    for more in counts:
        done = done.join(more, key, "left")
    wanted = pages.select(key, (F.col(images) if images else F.array().cast("array<string>")).alias("expected"))
    done = done.join(wanted, key).withColumn("i", settled_images(F.col("html"), F.col("expected")))
    issues.append(issue(F.col("i.stray") > 0, "image_hallucinated", F.lit("warning"), F.col("i.stray")))
    issues.append(issue(F.col("i.missing") > 0, "image_missing", F.lit("warning"), F.col("i.missing")))
    issues.append(issue(F.col("i.duplicated") > 0, "image_duplicated", F.lit("info"), F.col("i.duplicated")))
    return done.select(key, F.col("i.text").alias("html"), F.array_compact(F.array(*issues)).alias("issues"))


def anomalies(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, titles, title_again): titles by class if there are several (else 0), and headings that repeat the title."""
    text = F.coalesce(html, F.lit(""))
    by_class = F.regexp_count(text, F.lit(r'(?i)class\s*=\s*"[^"]*\bdoc-title\b(?!-)[^"]*"'))
    title = tx.heading_norm(F.regexp_extract(text, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    inner = F.regexp_extract_all(text, F.lit(r"(?is)<h([2-6])\b[^>]*>(.*?)</h\1>"), F.lit(2))
    again = F.when(title != "", F.size(F.filter(F.transform(inner, tx.heading_norm), lambda n: n == title))).otherwise(0)
    return pages.select(key, F.when(by_class > 1, by_class).otherwise(0).alias("titles"), again.alias("title_again"))

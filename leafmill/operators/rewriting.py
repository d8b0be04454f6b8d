"""Checks and repairs of rewritten documents: lost tables, reports, loops cut off, chunks, captions by images, official headers, pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import outlines as rules
from leafmill.functions import text as tx
from leafmill.operators import quality, structure

TABLE = r"(?i)<table\b[\s\S]*?</table>"
#: The line before tables that have lost their place, and the caption of each.
TABLES_LOST, TABLE_NAME = "<p><strong>附录: 未能定位到原位置的表格</strong></p>", "原始表格 "
ISSUES = "array<struct<type:string,severity:string,n:bigint>>"
PLACEHOLDER = "__IMG_[0-9]+__"


def issue(bad: Column, name: str, severity: str, n: Column) -> Column:
    """One issue as a struct, or null."""
    return F.when(bad, F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), n.cast("long").alias("n")))


# -- tables ------------------------------------------------------------------


def claimed_tables(source: Column, output: Column) -> Column:
    """For each key of the source the number of the first output key that matches and that no earlier one has taken, or -1; -2 below two characters.

    Keys match that are equal or one in the other, and a long one whose first and last 80 characters are in the other.
    """

    def claim(keys: list[str], found: list[str]) -> list[int]:
        free, out = {i: o for i, o in enumerate(found) if o}, []
        for key in keys:
            pick = -2
            if len(key) >= 2:
                head, tail = (key[:80], key[-80:]) if len(key) >= 160 else (key, key)
                pick = next((i for i, o in free.items() if head in o and tail in o or o in key), -1)
                free.pop(pick, None)
            out.append(pick)
        return out

    @F.pandas_udf("array<int>")
    def picks(sources: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([claim(list(a), list(b)) for a, b in zip(sources, outputs)], dtype=object)

    return picks(source, output)


def with_missing_tables(pairs: DataFrame, key: str, source: str, output: str) -> DataFrame:
    """(key, html, issues): the source's tables that the output lost stand at its end. Tables without text need no match."""
    rows = pairs.select(key, F.coalesce(output, F.lit("")).alias("out"), F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(TABLE), F.lit(0)).alias("tables"), rules.table_keys(F.coalesce(source, F.lit(""))).alias("keys"), rules.table_keys(F.coalesce(output, F.lit(""))).alias("found"))
    rows = rows.withColumn("picks", claimed_tables(F.col("keys"), F.col("found")))
    lost = F.filter("tables", lambda t, i: F.get(F.col("picks"), i) == -1)
    rows = rows.withColumn("lost", lost)
    named = F.transform("lost", lambda t, i: F.concat(F.lit(f'<div class="table-caption">{TABLE_NAME}'), (i + 1).cast("string"), F.lit("</div>"), t))
    html = F.when(F.size("lost") > 0, F.concat("out", F.lit(TABLES_LOST), F.array_join(named, ""))).otherwise(F.col("out"))
    return rows.select(key, html.alias("html"), F.array_compact(F.array(issue(F.size("lost") > 0, "table_missing", "warning", F.size("lost")))).alias("issues"))


# -- report ------------------------------------------------------------------


def report(pairs: DataFrame, key: str, before: str, after: str, issues: str) -> DataFrame:
    """(key, input, output, retention, headings_matched, issues, truncated): the report on a rewritten document.

    Headings match if there are as many as before and no issue says that some are lost.
    """
    rows = pairs.select(key, F.struct(*structure.counts(F.col(before))).alias("input"), F.struct(*structure.counts(F.col(after))).alias("output"), F.coalesce(F.col(issues), F.array().cast(ISSUES)).alias("issues"))
    of = lambda *names: F.exists("issues", lambda i: i["type"].isin(*names))
    retention = F.when(F.col("input.chars") > 0, F.floor(100 * F.col("output.chars") / F.col("input.chars") + 0.5)).otherwise(100)
    matched = (F.col("output.headings") >= F.col("input.headings")) & ~of("heading_missing", "early_stop", "headings_reduced")
    return rows.select(key, "input", "output", retention.cast("long").alias("retention"), matched.alias("headings_matched"), "issues", of("loop_truncated", "stream_hallucination", "early_stop").alias("truncated"))


# -- loops -------------------------------------------------------------------

#: Characters at the end of the plain text that are searched, and the least text.
TAIL, LEAST = 5000, 200
#: Ends of blocks, items with a number in brackets, sentences, empty paragraphs.
CLOSER = re.compile(r"</(?:h[1-6]|p|li|div)>")
NUMBERED = re.compile(r"[（(]\s*[0-9]+\s*[）)]\s*([^\n（(]{5,120})")
SENTENCE = re.compile(r"[^。！？!?\n]{20,150}[。！？!?]")
EMPTY = re.compile(r"<p>(?:\s|&nbsp;)*</p>", re.I)
EMPTIES = re.compile(r"(?:<p>(?:\s|&nbsp;)*</p>\s*){10}", re.I)


def segments_again(tail: str) -> Iterator[tuple[int, int]]:
    """The same 35 to 450 characters three times or more at the end."""
    for size in range(35, 451, 15):
        last, at, n = tail[-size:].strip(), len(tail) - size, 1
        if len(last) < 20:
            continue
        while at >= size and tail[at - size : at].strip() == last:
            at, n = at - size, n + 1
        if n >= 3:
            yield at, 3 * size


def items_again(tail: str) -> Iterator[tuple[int, int]]:
    """Numbered items that grow by and by, or that have one body, among the last eight."""
    found = list(NUMBERED.finditer(tail))[-8:]
    if len(found) < 5:
        return
    bodies = [m[1].strip() for m in found]
    if sum(bool(a and b) and (a.startswith(b) or b.startswith(a)) for a, b in zip(bodies, bodies[1:])) >= len(bodies) - 2:
        yield found[0].start(), 200
    if len(bodies[-1]) >= 8 and bodies.count(bodies[-1]) >= 5:
        yield found[bodies.index(bodies[-1])].start(), 100


def sentences_again(tail: str) -> Iterator[tuple[int, int]]:
    """One sentence five times among the last ten."""
    found = list(SENTENCE.finditer(tail))
    if len(found) >= 8:
        last = [(m[0].strip(), m.start()) for m in found[-10:]]
        counts = Counter(s for s, _ in last)
        for s in dict.fromkeys(s for s, _ in last):
            if counts[s] >= 5:
                yield next(at for t, at in last if t == s), 300


def lines_in_turn(tail: str) -> Iterator[tuple[int, int]]:
    """Two different lines in turn, four times."""
    lines = [s for s in (m.strip() for m in re.findall(r"[^\n]{30,300}", tail)) if len(s) >= 30 and re.search("[一-龥a-zA-Z]{10,}", s)][-8:]
    if len(lines) == 8 and len(set(lines[::2])) == 1 and len(set(lines[1::2])) == 1 and lines[0] != lines[1]:
        yield max(0, len(tail) - 800), 300


def short_groups(tail: str) -> Iterator[tuple[int, int]]:
    """A group of up to six characters thirteen times in a row near the end."""
    if re.search(r"(.{1,6})\1{12,}", tail[-300:]):
        yield len(tail) - 300, 100


LOOPS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "segment": segments_again, "numbered": items_again, "sentence": sentences_again, "turns": lines_in_turn, "characters": short_groups,
}


def cut_point(html: str, plain: str, start: int, slack: int) -> int | None:
    """The end of the last block before a place of the plain text, which is carried over to the HTML in proportion; None in the first twentieth."""
    upto = min(len(html), int(len(html) * (start / len(plain))) + slack)
    ends = [m.end() for m in CLOSER.finditer(html, 0, upto)]
    return ends[-1] if ends and ends[-1] > 0.05 * len(html) else None


def loop(html: str | None) -> tuple[str | None, int | None]:
    """The first kind of loop at the end of a document for which there is a place to cut, and that place."""
    plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html or "")).strip()
    if len(plain) < LEAST:
        return None, None
    tail = plain[-TAIL:]
    for name, find in LOOPS.items():
        for at, slack in find(tail):
            if (cut := cut_point(html, plain, len(plain) - len(tail) + at, slack)) is not None:
                return name, cut
    if len(EMPTY.findall(html)) >= 15 and (m := EMPTIES.search(html)):
        if (cut := cut_point(html, plain, int(m.start() / len(html) * len(plain)), 50)) is not None:
            return "empty", cut
    return None, None


def without_loops(docs: DataFrame, column: str = "html") -> DataFrame:
    """``docs`` with ``loop`` (what was found, or null), the loop being cut off ``column`` at the end of a block."""

    @F.pandas_udf("loop string, cut int")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([loop(t) for t in texts], columns=["loop", "cut"]).astype({"cut": "Int32"})

    rows = docs.withColumn("__loop", found(F.col(column)))
    cut = F.when(F.col("__loop.cut").isNotNull(), F.substring(F.col(column), F.lit(1), F.col("__loop.cut"))).otherwise(F.col(column))
    return rows.withColumns({column: cut, "loop": F.col("__loop.loop")}).drop("__loop")


# -- chunks ------------------------------------------------------------------


def listed(html: Column) -> Column:
    """List items, or numbers in brackets if there are more of these."""
    return F.greatest(F.regexp_count(html, F.lit(r"(?i)<li\b")), F.regexp_count(html, F.lit(r"[(（]\s*[0-9]+\s*[)）]")))


def missing_headings(titles: Column, output: Column) -> Column:
    """The titles that no heading of the output contains or is contained in; those under three characters don't count."""
    inner = F.regexp_extract_all(output, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    norm = lambda t: F.lower(tx.heading_norm(tx.compact(t)))
    found = F.filter(F.transform(inner, norm), lambda n: n != "")
    wanted = F.filter(F.transform(titles, lambda t: F.struct(t.alias("title"), norm(t).alias("norm"))), lambda t: F.length(t["norm"]) >= 3)
    # bound: inside the lambda the output's headings would be made anew for each title
    lost = tx.bound(found, lambda own: F.filter(wanted, lambda t: ~F.exists(own, lambda f: F.contains(f, t["norm"]) | F.contains(t["norm"], f))))
    return F.transform(lost, lambda t: t["title"])


def checked_chunks(chunks: DataFrame, before: str, after: str, headings: str, key: list[str]) -> DataFrame:
    """(key, issues, missing_headings, missing_images): seven checks of a rewritten chunk against its source (``headings``: its titles)."""
    source, output = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    n_in, n_out = F.length(tx.compact(source)), F.length(tx.compact(output))
    images = lambda t: F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0))
    tables = lambda t: F.regexp_count(t, F.lit(r"(?i)<table\b"))
    rows = chunks.select(
        *key, source.alias("s"), output.alias("o"), n_in.alias("n_in"), n_out.alias("n_out"), listed(source).alias("l_in"), listed(output).alias("l_out"),
        missing_headings(F.col(headings), output).alias("missing_headings"), tx.bound(images(output), lambda own: F.filter(images(source), lambda i: ~F.array_contains(own, i))).alias("missing_images"),
    )
    when = lambda bad, name: F.when(bad, F.lit(name))
    found = [
        when((F.col("n_in") > 500) & (F.col("n_out") < F.floor(F.col("n_in") * 0.45)), "too_short"),
        when((F.col("n_in") > 500) & (F.col("n_out") > F.col("n_in") * 3.8), "too_long"),
        when(F.size("missing_headings") > 0, "headings"),
        when(F.size("missing_images") > 0, "images"),
        when((tables(F.col("s")) > 0) & (tables(F.col("o")) < tables(F.col("s"))), "tables"),
        when((F.col("l_in") >= 5) & (F.col("l_out") < F.floor(F.col("l_in") * 0.6)), "list_items"),
        when(F.greatest(*quality.loop_signs(F.col("o"))), "repetition"),
    ]
    return rows.select(*key, F.array_compact(F.array(*found)).alias("issues"), "missing_headings", "missing_images")


def first_heading(html: str) -> str:
    """A chunk's first heading, else its first block with text, else its text; at most 80 characters."""
    for pattern, group in ((r"<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1), (r"<(p|div|section|article|li|td|th)\b[^>]*>(.*?)</\1>", 2)):
        m = re.search(pattern, html, re.S | re.I)
        if m and (text := squeezed(m[group]).strip()):
            return text[:80]
    return squeezed(html).strip()[:80]


def squeezed(html: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html))


def unnumbered(text: str) -> str:
    """Without numbers of chapters and sections."""
    return re.sub(r"\s+", " ", re.sub(r"第[一-龥\d]+[章节条款部分]\s*", "", re.sub(r"(?:\d+\.)+\s*", "", text))).strip()


#: A chunk is covered if so much of what is written already begins it, in characters and as a share of its first ``WINDOW``.
COVERED, COVERED_SHARE, WINDOW = 320, 0.78, 2600


def uncovered_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, overlap, coverage, skipped): chunks whose beginning is what stands at the end of the outputs so far.

    ``chunks`` is (doc_id, chunk_no, content, output). A fold over a document's
    chunks carries the end of what was written (plain text, three windows and
    more); outputs of skipped chunks aren't written. Null contents count as empty.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, written = object(), ""
        for batch in batches:
            out = []
            for doc_id, chunk_no, content, output in zip(*map(values, batch.columns)):
                first = doc_id != now
                if first:
                    now, written = doc_id, ""
                content = content or ""
                head = squeezed(content).strip()
                overlap = 0 if first else tx.overlap(unnumbered(written)[-WINDOW:], unnumbered(head)[:WINDOW], 80, WINDOW)
                coverage = overlap / min(len(head), WINDOW) if head else 0.0
                skip = overlap >= COVERED and coverage >= COVERED_SHARE and bool(heading := first_heading(content)) and heading in written.strip()[-5000:]
                if not skip:
                    written = re.sub(" +", " ", written + squeezed(output or ""))[-4 * WINDOW :]
                out.append((doc_id, chunk_no, overlap, coverage, skip))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*batch.schema.types[:2], pa.int32(), pa.float64(), pa.bool_()])], ["doc_id", "chunk_no", "overlap", "coverage", "skipped"])

    own = chunks.select("doc_id", "chunk_no", "content", "output").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_no")
    return own.mapInArrow(fold, f"doc_id {kinds['doc_id']}, chunk_no {kinds['chunk_no']}, overlap int, coverage double, skipped boolean")


def values(column: pa.Array) -> Iterator:
    """A column's values one after the other, so that a batch's texts aren't all held twice."""
    return (x.as_py() for x in column)


def reattached(chunks: DataFrame, chunk_headings: str, level_map: str) -> Column:
    """The headings of a chunk with the level that the document gives them, where it knows them: array of (level, title)."""
    known = F.col(level_map)
    return F.transform(F.col(chunk_headings), lambda h: F.struct(F.coalesce(F.element_at(known, F.lower(F.trim(h["title"]))), h["level"]).alias("level"), h["title"].alias("title")))


# -- captions beside images --------------------------------------------------


def with_placeholders(pairs: DataFrame, before: str, after: str) -> Column:
    """The output with the placeholders that it lost: each before a caption that has none in the 500 characters ahead of it, the rest at the end."""

    @F.pandas_udf("string")
    def of(sources: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([put_back(s, o) for s, o in zip(sources, outputs)])

    return of(F.col(before), F.col(after))


def put_back(source: str | None, output: str | None) -> str | None:
    if output is None:
        return None
    there = set(re.findall(PLACEHOLDER, output))
    lost = iter([p for p in re.findall(PLACEHOLDER, source or "") if p not in there])

    def place(m: re.Match) -> str:
        if re.search(PLACEHOLDER, output[max(0, m.start() - 500) : m.start()]):
            return m[0]
        p = next(lost, None)
        return m[0] if p is None else f"{p}\n{m[0]}"

    return re.sub(r'<div\s+class="figure-caption"', place, output, flags=re.I) + "".join(f"\n<p>{p}</p>" for p in lost)


def with_figure_captions(html: Column, before: Column) -> Column:
    """A caption below each image placeholder that has none in the next 600 characters, numbered on from ``before``."""
    parts = F.split(html, f"(?<={PLACEHOLDER.replace('+', '{1,9}')})", -1)
    mark = 'class="figure-caption"'
    # each part but the last ends in a placeholder of at least nine characters, so 68 parts hold the next 600
    after = lambda every, i: F.substring(F.array_join(F.slice(every, i + 2, F.lit(68)), ""), 1, 600)
    lacks = lambda every, i: (i < F.size(every) - 1) & ~F.contains(after(every, i), F.lit(mark))
    near = tx.bound(parts, lambda every: F.transform(every, lambda p, i: F.struct(i.alias("at"), p.alias("text"), lacks(every, i).alias("lacks"))))
    # captions in order, those that stand there as -1 and new ones by their part: a caption's number is its place
    new = lambda x: F.when(x["lacks"], F.array(x["at"])).otherwise(F.array().cast("array<int>"))
    captions = F.flatten(F.transform(near, lambda x: F.concat(F.array_repeat(F.lit(-1), F.regexp_count(x["text"], F.lit(mark))), new(x))))
    written = lambda n: F.concat(F.lit('\n<div class="figure-caption">Figure '), (before + n + 1).cast("string"), F.lit("</div>"))
    added = F.filter(F.transform(captions, lambda at, n: F.struct(at.alias("at"), written(n).alias("caption"))), lambda c: c["at"] >= 0)
    others = F.transform(F.filter(near, lambda x: ~x["lacks"]), lambda x: F.struct(x["at"].alias("at"), F.lit("").alias("caption")))
    return F.array_join(F.zip_with(parts, F.array_sort(F.concat(added, others)), lambda p, c: F.concat(p, c["caption"])), "")


# -- official documents ------------------------------------------------------

#: Classes of an official document's header in the order in which they stand.
SLOTS = ["doc-classification", "doc-urgency", "doc-issuer", "doc-divider", "doc-ref-number", "doc-title", "doc-addressee"]
HEADER_BLOCK = r"(?is)<(p|div|h[1-6])\b([^>]*)>(.*?)</\1>"


def official_classes(html: Column) -> Column:
    """Paragraphs and headings of an official document's header get the class that their text shows."""
    parts, whole = F.split(html, HEADER_BLOCK, -1), F.regexp_extract_all(html, F.lit(HEADER_BLOCK), F.lit(0))

    def read(block: Column) -> Column:
        part = lambda i: F.regexp_extract(block, HEADER_BLOCK, i)
        text = F.regexp_replace(F.regexp_replace(part(3), "<[^>]+>", ""), rf"^{tx.SPACE}+|{tx.SPACE}+$", "")
        return F.struct(block.alias("block"), part(1).alias("tag"), part(2).alias("attrs"), part(3).alias("inner"), text.alias("text"))

    titled = html.rlike('class="[^"]*doc-title[^"]*"')

    def classed(x: Column) -> Column:
        block, text, attrs, inner = x["block"], x["text"], x["attrs"], x["inner"]
        short = lambda n, pattern, but=None: (F.length(text) < n) & text.rlike(pattern) & (~text.rlike(but) if but else F.lit(True))
        made = lambda name, tag="p": F.concat(F.lit(f'<{tag} class="{name}">'), inner, F.lit(f"</{tag}>"))
        return (
            F.when(attrs.rlike('class="[^"]*doc-') | (text == "") | (F.length(text) > 120), block)
            .when(text.rlike(r"[★☆]|^(?:绝密|机密|秘密)(?:[\s\x{3000}]*[0-9]+年?)?$"), made("doc-classification"))
            .when(text.rlike("^(?:特急|加急|紧急|平急)$"), made("doc-urgency"))
            .when(short(35, r"[〔【\[][0-9]{4}[〕】\]][0-9]+号"), made("doc-ref-number"))
            .when(short(45, "文件$", "[。，！？]"), made("doc-issuer", "div"))
            .when(short(100, "[:：]$", "[。！？]"), made("doc-addressee"))
            .when((F.lower(x["tag"]) == "h1") & ~titled & ~attrs.contains("class="), made("doc-title", "h1"))
            .otherwise(block)
        )

    # each block is read once: in one expression every rule would read it again
    done = F.transform(F.transform(whole, read), classed)
    return F.array_join(F.flatten(F.zip_with(parts, F.concat(done, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def taken_out(html: str, name: str) -> tuple[str, str]:
    """The first element of a class with all that stands inside it, and the text without it."""
    if name == "doc-divider":
        m = re.search(rf'<hr\b[^>]*class="[^"]*{name}[^"]*"[^>]*/?>', html, re.I)
        return (m[0], html[: m.start()] + html[m.end() :]) if m else ("", html)
    m = re.search(rf'<(div|p|h[1-6]|section)\b[^>]*\bclass="[^"]*{name}[^"]*"[^>]*>', html, re.I)
    if not m:
        return "", html
    depth, end = 1, m.end()
    for t in re.finditer(rf"<(/?){m[1].lower()}(?=[\s>])", html[m.end() :]):
        depth += -1 if t[1] else 1
        end = m.end() + t.end() + bool(t[1])
        if not depth:
            break
    return html[m.start() : end], html[: m.start()] + html[end:]


def official_order(html: str | None) -> str | None:
    """The header's elements first, in their order; a divider goes below the issuer. Without a title nothing moves."""
    rest, found = html or "", {}
    for name in SLOTS:
        found[name], rest = taken_out(rest, name)
    if html is None or not found["doc-title"]:
        return html
    if found["doc-issuer"] and not found["doc-divider"]:
        found["doc-divider"] = '<hr class="doc-divider">'
    return "\n".join(x for x in found.values() if x) + "\n" + rest.strip()


def official(docs: DataFrame, column: str = "html") -> DataFrame:
    """``docs`` with the header of official documents marked and in order."""

    @F.pandas_udf("string")
    def ordered(texts: pd.Series) -> pd.Series:
        return texts.map(official_order)

    return docs.withColumn(column, ordered(official_classes(F.col(column))))


# -- pages -------------------------------------------------------------------


def sheets(blocks: DataFrame, usable: float, columns: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, pos, sheet, sheets): the page of each block (key, pos, top, cover, split), ``top`` being its place in one long column.

    A block begins a page if it stands a page's usable height or more below the
    page's first; behind the row that splits (``split``) the height counts once a
    column. A cover has a page of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, pages = object(), [], []  # the key at hand, the places of its blocks and their pages
        sheet, held, start, height = 1, 0, None, usable
        for batch in batches:
            done = [[], [], [], []]
            for k, pos, top, cover, split in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    for column, part in zip(done, ([now] * len(own), own, pages, [max(pages, default=0)] * len(own))):
                        column += part
                    now, own, pages = k, [], []
                    sheet, held, start, height = 1, 0, None, usable
                start = top if start is None else start
                own.append(pos)
                if cover:
                    sheet += held > 0
                    pages.append(sheet)
                    sheet, held, start = sheet + 1, 0, None  # the next block begins the page
                    continue
                if top - start >= height and held:
                    sheet, held, start = sheet + 1, 0, top
                held += 1
                pages.append(sheet)
                height = usable * columns if split else height
            kind = [*batch.schema.types[:2], pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, kind)], [key, "pos", "sheet", "sheets"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([now] * len(own), own, pages, [max(pages)] * len(own)), kind)], [key, "pos", "sheet", "sheets"])

    # sorted rows are walked as they come: a frame of pandas for each key took most of the time
    own = blocks.select(key, "pos", "top", "cover", "split").repartition(key).sortWithinPartitions(key, "pos")
    return own.mapInArrow(pack, f"{key} {kinds[key]}, pos {kinds['pos']}, sheet int, sheets int")


def paragraphs_as_headings(rows: DataFrame, patterns: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """(key, pos, level, title): paragraphs (key, pos, line) that look like headings, with the level of the first pattern that fits."""
    level = F.coalesce(*(F.when(F.col("line").rlike(p), n) for p, n in patterns))
    return rows.withColumn("level", level).where("level is not null").select(key, "pos", "level", F.col("line").alias("title"))


def chunk_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` (key, chunk_no, n) with ``so_far``: the sum over the chunks before."""
    before = Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("so_far", F.coalesce(F.sum("n").over(before), F.lit(0)))

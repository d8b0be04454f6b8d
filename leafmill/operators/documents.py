"""Order-dependent work on single documents, in Arrow batches: splitting, aligning, repairing.

Each function looks at one document; documents are dealt out as Spark reads them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx

LOOK_AHEAD, LOOK_BACK = 2000, 1000
IMAGE = re.compile("__IMG_[0-9]+__")
#: Texts that ``repaired`` holds at once outside of Arrow.
AT_ONCE = 64


def cut_at(text: str, pos: int, most: int) -> tuple[int, str]:
    """Where the piece that begins at ``pos`` ends, and why: heading, block, line, word, or by force."""
    target, early = pos + most, pos + int(0.7 * most)
    headings = [m.start() for m in re.finditer(r"(?i)<h[1-6]", text[early + 1 : target])]
    if headings:
        return early + 1 + headings[-1], "heading"
    closers = [m.end() for m in re.finditer(r"(?i)</(?:p|div|li|ul|ol|table|h[1-6])>", text[early:target])]
    if closers:
        return early + closers[-1], "block"
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, max(pos, target - LOOK_BACK), target)
        if at > pos:
            return at + len(mark), "line"
    for pattern in ("\n", r"\s"):
        found = re.search(pattern, text[target : target + LOOK_AHEAD])
        if found:
            return target + found.end(), "word"
    return target, "cut"


def pieces(text: str, most: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, strategy) of pieces that join to the text and never cut a placeholder."""
    pos = 0
    while len(text) - pos > most:
        end, why = cut_at(text, pos, most)
        for m in IMAGE.finditer(text, max(pos, end - 20), end + 20):
            if m.start() < end < m.end():
                end = m.start() if m.start() > pos else end
        yield pos, end, why
        pos = end
    if pos < len(text) or not text:
        yield pos, len(text), "rest" if pos else "single"


def chunks(docs: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc_id, chunk_no, start, end, strategy, content): texts split by meaning; the pieces join to the text. Null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, a, b, why, t[a:b]) for d, t in zip(batch["doc_id"], batch["text"]) if t is not None for n, (a, b, why) in enumerate(pieces(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "start", "end", "strategy", "content"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, chunk_no int, start int, end int, strategy string, content string")


def packed(docs: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc_id, chunk_no, start, end, strategy): sections between headings packed up to ``most``; larger ones are split by meaning."""

    def sections(text: str) -> Iterator[tuple[int, int, str]]:
        marks = [m.start() for m in re.finditer(r"(?i)<h[1-6]", text)]
        if len(text) <= most or not marks:
            yield from ((a, b, "single" if len(text) <= most else "semantic-fallback") for a, b, _ in pieces(text, most))
            return
        edges = sorted({0, *marks, len(text)})
        start = 0
        for a, b in zip(edges, edges[1:]):
            if b - a > most:
                if a > start:
                    yield start, a, "heading-aggregate"
                yield from ((a + x, a + y, f"heading-section-large:{'continued' if x else 'first'}") for x, y, _ in pieces(text[a:b], most))
                start = b
            elif b - start > most:
                yield start, a, "heading-aggregate"
                start = a
        if start < len(text):
            yield start, len(text), "heading-aggregate"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, *x) for d, t in zip(batch["doc_id"], batch["text"]) for n, x in enumerate(sections(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "start", "end", "strategy"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, chunk_no int, start int, end int, strategy string")


def compressed(groups: DataFrame, least: int = 240, share: float = 0.78) -> DataFrame:
    """(doc_id, kept): the numbers of chunks (array ``chunks``) that the last kept one doesn't cover."""

    @F.pandas_udf("array<int>")
    def kept(column: pd.Series) -> pd.Series:
        def of(chunks: list[str]) -> list[int]:
            out: list[int] = []
            for i, c in enumerate(chunks):
                same = tx.overlap(chunks[out[-1]], c) if out else 0
                if not (same >= least and same / max(1, min(len(c), 2600)) >= share):
                    out.append(i)
            return out

        return column.map(of)

    return groups.select("doc_id", kept("chunks").alias("kept"))


def aligned(pairs: DataFrame) -> DataFrame:
    """(doc_id, matches): ``aligned_rows`` of the arrays ``outline`` and ``found``."""
    return aligned_rows(pairs, "outline", "found", "matches").select("doc_id", "matches")


def aligned_rows(rows: DataFrame, outline: str, found: str, to: str, least: float = 0.85) -> DataFrame:
    """``rows`` with ``to``: for each title of the array ``found`` the number of its title in ``outline``, or -1.

    An equal title at or after the cursor comes first, then an equal one anywhere,
    then the most similar one; each title of the outline is used once.
    """

    def match(outline: list[str], found: list[str]) -> list[int]:
        cursor, out, letters = 0, [], None
        places: dict[str, list[int]] = {}  # of each title's outline titles that are free
        for i, title in enumerate(outline):
            places.setdefault(title, []).append(i)
        for title in found:
            equal = places.get(title, [])
            at = bisect_left(equal, cursor)
            pick = equal[at] if at < len(equal) else equal[0] if equal else -1
            if pick < 0 and len(title) >= 3:
                letters = letters or Letters(list(places))
                best = (least, -len(outline))
                for bound, other in letters.near(title):
                    if bound < best[0]:
                        break
                    if places[other]:
                        best = max(best, (ratio(title, other), -places[other][0]))
                pick = -best[1] if -best[1] < len(outline) else -1
            if pick >= 0:
                places[outline[pick]].remove(pick)
                cursor = max(cursor, pick + 1)
            out.append(pick)
        return out

    @F.pandas_udf("array<int>")
    def matches(outlines: pd.Series, founds: pd.Series) -> pd.Series:
        return pd.Series([match(list(a), list(b)) for a, b in zip(outlines, founds)])

    return rows.withColumn(to, matches(outline, found))


class Letters:
    """Counts of the letters of titles, by which most of those that aren't similar are told without their edit distance."""

    def __init__(self, titles: list[str]) -> None:
        self.titles, self.lengths = titles, np.array([len(t) for t in titles])
        self.counts = np.stack([self.of(t) for t in titles]) if titles else np.zeros((0, 64), int)

    @staticmethod
    def of(title: str) -> np.ndarray:
        return np.bincount(np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)

    def near(self, title: str) -> list[tuple[float, str]]:
        """The titles that may have a ``ratio`` of 0.85, with the most that it can be, in falling order of that."""
        more = self.counts - self.of(title)
        longest = np.maximum(self.lengths, len(title))
        edits = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))  # each letter too many takes an edit
        chosen = np.flatnonzero(edits <= 0.15 * longest)
        return sorted(((1 - int(edits[i]) / int(longest[i]), self.titles[i]) for i in chosen), key=lambda x: -x[0])


def ratio(a: str, b: str) -> float:
    """1 - edit distance / greater length."""
    return 1 - tx.distance(a, b) / (max(len(a), len(b)) or 1)


def repaired(docs: DataFrame, column: str = "html") -> DataFrame:
    """``docs`` with tags that were left open closed at the end of ``column``, and closers without an opener dropped."""
    tag = re.compile(r"<(/?)(p|div|li|ul|ol|table|tr|td|th|tbody|thead|h[1-6]|strong|b|em|i|span)\b[^>]*>", re.I)

    def repair(html: str | None) -> str | None:
        if html is None:
            return None
        open_tags: list[str] = []
        n_open: Counter[str] = Counter()

        def meet(m: re.Match) -> str:
            name = m[2].lower()
            if not m[1]:
                open_tags.append(name)
                n_open[name] += 1
                return m[0]
            if not n_open[name]:
                return ""
            closing = []
            while (last := open_tags.pop()) != name:
                n_open[last] -= 1
                closing.append(f"</{last}>")
            n_open[name] -= 1
            return "".join(closing) + m[0]

        return tag.sub(meet, html) + "".join(f"</{t}>" for t in reversed(open_tags))

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        # a few texts at a time are Python's; the others stay as Arrow holds them
        parts = [pa.array([repair(t) for t in column.slice(i, AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(column), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else column

    return docs.withColumn(column, of(F.col(column)))

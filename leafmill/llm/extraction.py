"""HTML extraction by deducing each host's template from equivalence classes of tokens.

Tokens are the structural nodes of a page, told apart by their place (the path of
names and classes from the root), and its whole blocks of text with their place.
A token's occurrence vector holds its count on each page of the host. Tokens of one
vector form an equivalence class: those of the root's class stand once on every
page and make up the template's frame, others (list items, paragraphs) nest in the
slots between. Vectors aren't stored: a page adds a hash of itself and the count to
two sums, which merge in any order, so a host may have any number of pages.

A class counts if it stands on half of the host's pages. Classes are split by the
slot they stand in, so that each nests in one slot of one other class. The slot
that holds the main text is found from the root down: of the nodes of the frame
the walk goes on to the one that holds nearly all of what is neither fixed text,
nor mostly links, nor named as something else (menus, adverts, comments and the
like). Texts of the root's class inside it are fixed and are left out, unless they
are most of its text: then the host's pages all hold the same article.

Extraction reads each page again with its host's template, and keeps the slot's
blocks. A page without the slot of its host is treated as a host of its own.

Edge cases: null and empty pages have an empty text. Pages whose url is null or
has no host form one host. Repeated rows give repeated rows; tables without rows
give none; further columns are left out. Hosts of fewer than ``MIN_PAGES`` pages
have no fixed texts. Long pages take time and memory in proportion.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, markup
from leafmill.llm.markup import ROOT, Node, Text, hashed

#: Pages that a host needs before a repeated text counts as part of its template.
MIN_PAGES = 3
#: Share of the text that a child must hold for the walk to go on to it; share of links beyond which a node is a menu.
DOMINANT, LINKED = 0.8, 0.6
#: Elements and words of ids and classes that name what isn't the main text.
ELEMENTS = frozenset("nav header footer aside form menu dialog noscript template button select object canvas svg head".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead topbar header footer cookie cookies consent gdpr notice notices alert disclaimer comment comments disqus respond replies "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay widget widgets pagination pager toolbar search login copyright".split()
)
#: Elements that hold text itself, and those that name a main part.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table figure figcaption".split())
MAIN = frozenset("article main".split())


class Template(NamedTuple):
    """The main slot, the nodes above it, nodes left out inside it, and fixed texts."""

    main: int
    above: frozenset[int]
    out: frozenset[int]
    fixed: frozenset[int]


class Seen(NamedTuple):
    """A node of a host: its place, and totals over the host's pages."""

    id: int
    parent: int
    label: str
    in_frame: bool
    chars: int
    linked: int


def name_of(label: str) -> str:
    return re.split(r"[#.@!]", label, maxsplit=1)[0]


def foreign(label: str, inside: bool = False) -> bool:
    """Whether a label names something other than main text; ``inside`` the main slot a header belongs to it."""
    name, *marks = re.split(r"[#.@!]", label)
    words = {w for m in marks for w in re.split(r"[-_\s:]+", m)}
    if inside and (name == "header" or words & {"header"}) and not words & (WORDS - {"header"}):
        return False
    return name in ELEMENTS or bool(words & WORDS) or label.endswith("!")


def blocks(page: str | None) -> Iterator[Node | tuple[int, str, int]]:
    """Nodes as they open, and blocks of text: (node, text with single spaces, characters inside links)."""
    at, node, parts, linked = -1, ROOT, [], 0
    for item in markup.read(page):
        if isinstance(item, Text):
            if item.block != at:
                if text := " ".join("".join(parts).split()):
                    yield node, text, linked
                at, node, parts, linked = item.block, item.node, [], 0
            parts.append(item.text)
            linked += item.link * len(item.text.strip())
        else:
            yield item
    if text := " ".join("".join(parts).split()):
        yield node, text, linked


def totals(page: str | None) -> tuple[dict[int, list], dict[int, list]]:
    """Nodes: id to [parent, label, count, characters, of them inside links]; texts: id to [node, count, characters]."""
    nodes: dict[int, list] = {ROOT: [ROOT, "", 1, 0, 0]}
    texts: dict[int, list] = {}
    for item in blocks(page):
        if isinstance(item, Node):
            nodes.setdefault(item.id, [item.parent, item.label, 0, 0, 0])[2] += 1
        else:
            node, text, linked = item
            own = nodes[node]
            own[3] += len(text)
            own[4] += linked
            found = texts.setdefault(hashed(node, text), [node, 0, 0])
            found[1] += 1
            found[2] += len(text)
    return nodes, texts


def deduced(nodes: Iterable[Seen], fixed: dict[int, tuple[int, int]]) -> Template:
    """The template of a host from its supported nodes and fixed texts (id to node and characters)."""
    by_id = {n.id: n for n in nodes}
    children: dict[int, list[Seen]] = defaultdict(list)
    for n in by_id.values():
        if n.id != ROOT and n.parent in by_id:  # a class nests only in a slot of the template
            children[n.parent].append(n)
    order = [ROOT]
    for at in order:
        order.extend(c.id for c in children[at])
    chars, linked, same = ({i: 0 for i in order} for _ in range(3))
    for i in order:
        chars[i], linked[i] = by_id[i].chars, by_id[i].linked
    for node, size in fixed.values():
        if node in same:
            same[node] += size
    for i in reversed(order[1:]):
        for total in (chars, linked, same):
            total[by_id[i].parent] += total[i]

    def free(i: int) -> int:
        return max(0, chars[i] - same[i])

    def other(n: Seen, inside: bool) -> bool:
        """Whether a node is named, or behaves, as something else than main text."""
        menu = chars[n.id] > 0 and linked[n.id] > LINKED * chars[n.id] and name_of(n.label) not in ("p", "article", "main")
        return foreign(n.label, inside) or menu

    main, above, inside = ROOT, [], False
    while True:
        own = [c for c in children[main] if not other(c, inside)]
        if not any(free(c.id) for c in own) and not by_id[main].chars:
            own = [c for c in children[main] if name_of(c.label) not in ELEMENTS]  # a name alone doesn't make the only text foreign
        frame = [c for c in own if c.in_frame and name_of(c.label) not in TEXTUAL]
        best = max(frame, key=lambda c: (free(c.id), -c.id), default=None)
        if best is None or not free(best.id):
            break
        named = [c for c in frame if name_of(c.label) in MAIN]
        if named and not inside:
            best = max(named, key=lambda c: (free(c.id), -c.id))
        else:
            rest = by_id[main].chars + sum(free(c.id) for c in own)
            if any(name_of(c.label) in TEXTUAL and free(c.id) for c in own) or free(best.id) < DOMINANT * rest:
                break
        above.append(main)
        main = best.id
        inside = inside or name_of(best.label) in MAIN
    under = [main]
    for at in under:
        under.extend(c.id for c in children[at])
    out = {i for i in under[1:] if other(by_id[i], True)}
    found = {t for t, (node, _) in fixed.items() if node in set(under)}
    if 2 * same[main] > chars[main]:
        found = set()
    return Template(main, frozenset(above), frozenset(out), frozenset(found))


def alone(page: str | None) -> Template:
    """The template of a page that is a host of its own: all its nodes, no fixed texts."""
    nodes, _ = totals(page)
    return deduced((Seen(i, p, label, n == 1, c, k) for i, (p, label, n, c, k) in nodes.items()), {})


def extracted(page: str | None, template: Template | None) -> str:
    """The main text of a page: its slot's blocks, one a line."""
    if not page:
        return ""
    if template is None:
        template = alone(page)
    kept: dict[int, bool] = {ROOT: template.main == ROOT}
    found, present = [], template.main == ROOT
    for item in blocks(page):
        if isinstance(item, Node):
            if item.id in kept:
                continue
            if item.id == template.main:
                kept[item.id] = present = True
            elif item.id in template.above:
                kept[item.id] = False
            else:
                kept[item.id] = kept[item.parent] and item.id not in template.out and not foreign(item.label, True)
        else:
            node, text, _ = item
            if kept[node] and not (template.fixed and hashed(node, text) in template.fixed):
                found.append(text)
    if not present:
        return extracted(page, alone(page))
    return "\n".join(found)


def host(url: Column) -> Column:
    """A hash of the host of a url; that of an empty host where there is none."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


SEEN = "host long, id long, parent long, label string, pages long, n long, a long, b long, chars long, linked long"


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each host as totals over a batch's pages; texts have no label. ``a`` and ``b`` are the vector's two sums."""

    def work(batch: pa.RecordBatch) -> dict:
        sums: dict[tuple, list] = {}
        for at, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes, texts = totals(page)
            key = hashed(page)
            rows = [(i, p, label, n, c, k) for i, (p, label, n, c, k) in nodes.items()]
            rows += [(i, node, None, n, c, 0) for i, (node, n, c) in texts.items()]
            for i, parent, label, n, c, k in rows:
                entry = hashed(key, n)
                own = sums.setdefault((at, i, label is None), [parent, label, 0, 0, 0, 0, 0, 0])
                own[2] += 1
                for j, more in enumerate((n, entry & 0x3FFFFFFF, (entry >> 30) & 0x3FFFFFFF, c, k), 3):
                    own[j] += more
        columns = list(zip(*((h, i, *rest) for (h, i, _), rest in sums.items()))) or [()] * 10
        kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in SEEN.split(", ")]
        return {f.split()[0]: pa.array(v, t) for f, v, t in zip(SEEN.split(", "), columns, kinds)}

    return common.per_batch(pages.select(host(F.col("url")).alias("host"), "html"), work, SEEN)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, above, out, fixed): the template of each host, from the supported classes of its tokens."""
    is_text = F.col("label").isNull()
    totals_of = [F.sum(c).alias(c) for c in ("pages", "n", "a", "b", "chars", "linked")]
    seen = tokens(pages).groupBy("host", "id", is_text.alias("is_text")).agg(F.min("parent").alias("parent"), F.min("label").alias("label"), *totals_of)
    # a text of one page only is in no class that counts, unless the host has no other page, and then there are no fixed texts
    seen, path = common.stage(seen.where(~F.col("is_text") | (F.col("pages") > 1)), "tokens")
    roots = seen.where((F.col("id") == ROOT) & ~F.col("is_text")).select("host", F.col("pages").alias("all"), F.col("a").alias("root_a"), F.col("b").alias("root_b"))
    roots, roots_path = common.stage(roots, "hosts")
    framed = (F.col("a") == F.col("root_a")) & (F.col("b") == F.col("root_b"))
    supported = F.when(F.col("is_text"), framed & (F.col("all") >= MIN_PAGES)).otherwise(2 * F.col("pages") >= F.col("all"))
    kept = seen.join(common.bounded(roots), "host").where(supported).select("host", "id", "is_text", "parent", "label", framed.alias("in_frame"), "chars", "linked")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        """A host's supported tokens are at most twice as many as a page of it has on average."""
        nodes = [Seen(r.id, r.parent, r.label, r.in_frame, r.chars, r.linked) for r in rows.itertuples() if not r.is_text]
        t = deduced(nodes, {r.id: (r.parent, r.chars) for r in rows.itertuples() if r.is_text})
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "main": [t.main], "above": [sorted(t.above)], "out": [sorted(t.out)], "fixed": [sorted(t.fixed)]})

    found, _ = common.stage(kept.groupBy("host").applyInPandas(one, "host long, main long, above array<long>, out array<long>, fixed array<long>"), "templates")
    for p in (path, roots_path):
        common.unstage(pages.sparkSession, p)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    common.prepare(pages.sparkSession)
    own = pages.select("page_id", "url", "html")
    found = own.withColumn("host", host(F.col("url"))).join(common.bounded(templates(own)), "host", "left")

    def work(batch: pa.RecordBatch) -> dict:
        made: dict[int, Template | None] = {}
        texts = []
        for i, page in enumerate(batch.column(3).to_pylist()):
            at = batch.column(0)[i].as_py()
            if at not in made:
                main, *sets = (batch.column(c)[i].as_py() for c in range(4, 8))
                made[at] = None if main is None else Template(main, *map(frozenset, sets))
            texts.append(extracted(page, made[at]))
        return {"page_id": batch.column(1), "url": batch.column(2), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    head = f"page_id {own.schema['page_id'].dataType.simpleString()}, url {own.schema['url'].dataType.simpleString()}"
    return common.per_batch(found.select("host", "page_id", "url", "html", "main", "above", "out", "fixed"), work, f"{head}, text string, n_chars long")

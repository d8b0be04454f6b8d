"""Checks and repairs of rewritten documents, case by case."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import quality
from leafmill.operators import rewriting as rw


def column(spark, html, make, *more):
    """The values that a column expression gives for some texts, in order."""
    df = spark.createDataFrame([(i, t, *m) for i, (t, *m) in enumerate(zip(html, *more))], "i int, html string" + "".join(f", m{k} {kind}" for k, kind in enumerate(["int"] * len(more))))
    return [r["x"] for r in df.select("i", make(df).alias("x")).orderBy("i").collect()]


def table(text):
    return f"<table><tr><td>{text}</td></tr></table>"


def test_missing_tables(spark):
    long = "x" * 90 + "middle" + "y" * 90
    cases = {
        "lost": (table("Kept") + table("Missing one"), f"<p>A</p>{table('kept&nbsp;')}"), "fine": (table("Only table"), "<p>Styled</p>" + table("Only  TABLE here")),
        "twice": (table("same") + table("same"), table("same")), "ends": (table(long), table("x" * 90 + "changed" + "y" * 90)), "short": (table("-"), "none"), "no source": (None, "text"), "no output": (table("ab"), None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "doc_id string, a string, b string")
    got = {r["doc_id"]: (r["html"], [(i["type"], i["n"]) for i in r["issues"]]) for r in rw.with_missing_tables(df, "doc_id", "a", "b").collect()}
    end = lambda *ts: rw.TABLES_LOST + "".join(f'<div class="table-caption">原始表格 {i}</div>{t}' for i, t in enumerate(ts, 1))
    assert got["lost"] == (cases["lost"][1] + end(table("Missing one")), [("table_missing", 1)]) and got["twice"][0] == table("same") + end(table("same"))
    for name in ("fine", "ends", "short"):
        assert got[name] == (cases[name][1], [])
    assert got["no source"] == ("text", []) and got["no output"][0] == end(table("ab"))


def test_report(spark):
    rows = [
        (1, "<h2>a</h2><p>" + "x" * 98 + "</p>", "<h2>a</h2><p>" + "x" * 48 + "</p>", []), (2, "<h2>a</h2>", "<h2>a</h2>", [("heading_missing", "warning", 1)]), (3, None, "<p>x</p>", None), (4, "<h2>a</h2>", "a", [("loop_truncated", "critical", 1)]),
    ]
    got = {r["id"]: r for r in rw.report(spark.createDataFrame(rows, f"id int, a string, b string, i {rw.ISSUES}"), "id", "a", "b", "i").collect()}
    assert [(got[i]["retention"], got[i]["headings_matched"], got[i]["truncated"]) for i in (1, 2, 4)] == [(49, True, False), (100, False, False), (100, False, True)]
    assert got[1]["input"]["headings"] == 1 and got[2]["issues"][0]["type"] == "heading_missing"


START = "".join(f"<p>A first paragraph, the number of which is {i * i}, stands here.</p>" for i in range(30))
WORDS = "".join(f"<p>{a} {b} matters little to {c} in the long run.</p>" for a, b, c in zip("abcdefghij", "klmnopqrst", "uvwxyzabcd"))
LOOPS = {
    "segment": "<p>" + "the same words come back " * 12 + "</p>",
    "numbered": "".join(f"<p>({i}) the one body that all of these items have</p>" for i in range(1, 9)),
    "sentence": "".join(f"<p>{'x' * i} filler of length {i * 7} to part them, well!</p><p>This sentence keeps coming back again.!</p>" for i in range(6)),
    "characters": "<p>" + "ab" * 40 + "</p>",
    "empty": "<p></p>" * 20,
}


@pytest.mark.parametrize("name", LOOPS)
def test_loops_are_cut_at_the_end_of_a_block(spark, name):
    html = START + WORDS + LOOPS[name]
    kind, cut = rw.loop(html)
    assert kind == name
    assert html[:cut].endswith(("</p>", "</li>", "</div>")) and len(html) * 0.05 < cut <= len(html)
    assert rw.loop(START + WORDS) == (None, None)  # what has no loop stays
    got = rw.without_loops(spark.createDataFrame([(1, html), (2, START + WORDS), (3, None), (4, "short")], "id int, html string")).orderBy("id").collect()
    assert [(r["html"], r["loop"]) for r in got] == [(html[:cut], kind), (START + WORDS, None), (None, None), ("short", None)]


def test_detectors_leave_what_only_looks_alike():
    assert not list(rw.items_again(" ".join(f"({i}) item {'abcdefgh'[i]} of its own kind" for i in range(8))))
    assert list(rw.items_again(" ".join(f"({i}) C" + "wake" + "e" * i + " and so" for i in range(8)))) == []
    assert list(rw.items_again(" ".join(f"({i}) grows{'e' * i}" for i in range(8))))
    lines = ["the introductory line has more than thirty letters in it", "the second line is considerably longer than that one is"]
    assert list(rw.lines_in_turn("\n".join(lines * 4))) and not list(rw.lines_in_turn("\n".join(lines * 3 + lines[:1] * 2)))
    assert not list(rw.short_groups("ab" * 12)) and list(rw.short_groups("ab" * 13))
    assert not list(rw.segments_again(" ".join(map(str, range(300)))))


def test_signs_of_loops(spark):
    body = "".join(f"({i}) repeated section body " for i in range(5))
    texts = [body, "".join(f"({i}) section body number {'abcde'[i]} " for i in range(5)), "One sentence that is long enough here! " * 8, "ab" * 15, "ab" * 14, "<b>a</b>" * 40, None, "x" * 30_000 + body, "<i a='" + "q" * 30_000 + "'>" + body]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["char_spam"], r["sentence_loop"], r["same_body"]) for r in quality.repetition(df).collect()}
    assert got[0][2] and not got[1][2] and got[2][1] and got[3][0] and not got[4][0] and got[5][0] and got[6] == (False, False, False) and got[7][2] and got[8][2]


def test_chunks(spark):
    text = "<p>" + "lorem ipsum dolor sit amet " * 40 + "</p>"
    items = "".join(f"<li>{i}</li>" for i in range(10))
    cases = {
        "fine": (text, text, ["1. Title one"], []), "short": (text, text[:200], [], ["too_short"]), "long": (text, " ".join(f"<p>{i} {i * i} words and more</p>" for i in range(400)), [], ["too_long"]),
        "heads": ("a", "<h2>2. Title  One more</h2>", ["Title one", "Another", "ab"], ["headings"]), "images": ("__IMG_1__ __IMG_2__", "__IMG_2__", [], ["images"]),
        "tables": (table(1), "x", [], ["tables"]), "items": (items, "<li>", [], ["list_items"]), "again": ("a", "cd" * 20, [], ["repetition"]), "null": (None, None, None, []),
    }
    cases["fine"] = (text, "<h3>Title one</h3>" + text, ["1. Title one"], [])
    df = spark.createDataFrame([(k, *v[:3]) for k, v in cases.items()], "k string, a string, b string, h array<string>")
    got = {r["k"]: r for r in rw.checked_chunks(df, "a", "b", "h", ["k"]).collect()}
    for name, (*_, issues) in cases.items():
        if name == "fine":  # the repeated words are a sentence of no end, so no sign
            assert "headings" not in got[name]["issues"]
        else:
            assert got[name]["issues"] == issues, name
    assert got["heads"]["missing_headings"] == ["Another"] and got["images"]["missing_images"] == ["__IMG_1__"]


def test_covered_chunks_are_skipped(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c = (f"<h2>{i}. Part {n}</h2><p>{prose(90)}</p>" for i, n in enumerate(("one", "two", "six"), 1))
    rows = [("d", 0, a, a), ("d", 1, b, b), ("d", 2, b, b), ("d", 3, c, c), ("d", 4, b, b), ("e", 0, a, a), ("e", 1, a + prose(400), "x"), ("e", 2, None, None), ("f", 0, a, "<p>other</p>"), ("f", 1, a, a)]
    got = rw.uncovered_chunks(spark.createDataFrame(rows, "doc_id string, chunk_no int, content string, output string")).collect()
    skipped = {(r["doc_id"], r["chunk_no"]) for r in got if r["skipped"]}
    assert skipped == {("d", 2)} and len(got) == len(rows)  # the fourth isn't at the end of what was written, "e" is covered in part only
    assert {(r["doc_id"], r["chunk_no"]): r["coverage"] > 0.9 for r in got}[("d", 2)]


def test_levels_from_the_document(spark):
    df = spark.createDataFrame([(1, [(2, "One"), (3, " Two ")], {"two": 5}), (2, [], {})], "id int, h array<struct<level:int,title:string>>, m map<string,int>")
    got = {r["id"]: [tuple(x) for x in r["x"]] for r in df.select("id", rw.reattached(df, "h", "m").alias("x")).collect()}
    assert got == {1: [(2, "One"), (5, " Two ")], 2: []}


def test_placeholders_and_captions(spark):
    caption = '<div class="figure-caption">Figure 9</div>'
    assert rw.put_back("__IMG_0__ __IMG_1__ __IMG_2__", f"a{caption}" + "z" * 600 + f"__IMG_2__{caption}") == f"a__IMG_0__\n{caption}" + "z" * 600 + f"__IMG_2__{caption}\n<p>__IMG_1__</p>"
    assert rw.put_back(None, "x") == "x" and rw.put_back("__IMG_0__", None) is None and rw.put_back("__IMG_0__", "__IMG_0__") == "__IMG_0__"
    made = lambda n: f'\n<div class="figure-caption">Figure {n}</div>'
    texts = ["__IMG_0__<p>body</p>", f"__IMG_0__{caption}<p>x</p>", f"__IMG_0__{'y' * 700}{caption}__IMG_1__ __IMG_12__ z", "none", None]
    want = [f"__IMG_0__{made(3)}<p>body</p>", texts[1], f"__IMG_0__{made(3)}{'y' * 700}{caption}__IMG_1__{made(5)} __IMG_12__{made(6)} z", "none", None]
    assert column(spark, texts, lambda df: rw.with_figure_captions(F.col("html"), F.lit(2))) == want


def test_official_documents(spark):
    parts = ["<p>机密★10年</p>", "<p>特急</p>", "<p>政发〔2026〕5号</p>", "<div>某某文件</div>", "<p>各部门：</p>", "<h1>关于建设的通知</h1>", "<p>正文第一段。</p>", '<p class="doc-x">特急</p>', "<p>" + "长" * 130 + "文件</p>"]
    names = ["doc-classification", "doc-urgency", "doc-ref-number", "doc-issuer", "doc-addressee", "doc-title"]
    marked = column(spark, ["\n".join(parts), '<p class="doc-title">已有</p><h1>x</h1>', ""], lambda df: rw.official_classes(F.col("html")))
    lines = marked[0].split("\n")
    assert [f'class="{n}"' in line for n, line in zip(names, lines)] == [True] * 6 and lines[6:] == parts[6:] and marked[1:] == ['<p class="doc-title">已有</p><h1>x</h1>', ""]
    nested = '<p>正文</p><div class="doc-issuer"><div>某某</div><div>文件</div></div><h1 class="doc-title">标题</h1><p class="doc-ref-number">号</p>'
    assert rw.official_order(nested) == '<div class="doc-issuer"><div>某某</div><div>文件</div></div>\n<hr class="doc-divider">\n<p class="doc-ref-number">号</p>\n<h1 class="doc-title">标题</h1>\n<p>正文</p>'
    assert rw.official_order('<p class="doc-ref-number">号</p><p>正文</p>') == '<p class="doc-ref-number">号</p><p>正文</p>' and rw.official_order(None) is None
    got = [r["html"] for r in rw.official(spark.createDataFrame([("\n".join(reversed(parts)),), (None,)], "html string")).collect()]
    at = [got[0].index(n) for n in ("doc-classification", "doc-urgency", "doc-issuer", "doc-divider", "doc-ref-number", "doc-title", "doc-addressee", "正文第一段")]
    assert at == sorted(at) and got[1] is None


def test_sheets(spark):
    docs = {
        "two": [(0, 0, 0), (500, 0, 0), (1050, 0, 0)], "one": [(0, 0, 0), (500, 0, 0), (900, 0, 0)], "columns": [(0, 0, 0), (200, 0, 1), (200, 0, 0), (1400, 0, 0)],
        "before": [(0, 0, 0), (1100, 0, 0)], "cover": [(0, 1, 0), (0, 0, 0)], "inside": [(0, 0, 0), (10, 1, 0), (1200, 0, 0), (2100, 0, 0), (2200, 0, 0)],
    }
    df = spark.createDataFrame([(k, i, float(t), bool(c), bool(s)) for k, rows in docs.items() for i, (t, c, s) in enumerate(rows)], "doc_id string, pos int, top double, cover boolean, split boolean")
    pages = lambda n: {k: [r["sheet"] for r in sorted(rs, key=lambda r: r["pos"])] for k, rs in _groups(rw.sheets(df, 1000, n).collect()).items()}
    assert pages(1) == {"two": [1, 1, 2], "one": [1, 1, 1], "columns": [1, 1, 1, 2], "before": [1, 2], "cover": [1, 2], "inside": [1, 2, 3, 3, 4]}
    assert pages(2)["columns"] == [1, 1, 1, 1] and pages(2)["before"] == [1, 2] and pages(2)["cover"] == [1, 2]


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_small_ones(spark):
    df = spark.createDataFrame([(1, 0, "第一章 总则"), (1, 1, "text"), (1, 2, "1.2 部分")], "doc_id int, pos int, line string")
    got = rw.paragraphs_as_headings(df, [("^第.+章", 1), (r"^\d+\.\d+\s", 2)]).orderBy("pos").collect()
    assert [(r["pos"], r["level"], r["title"]) for r in got] == [(0, 1, "第一章 总则"), (2, 2, "1.2 部分")]
    counts = rw.chunk_counts(spark.createDataFrame([(1, 0, 4), (1, 1, 2), (1, 2, 5), (2, 0, 9)], "doc_id int, chunk_no int, n int"))
    assert sorted((r["doc_id"], r["chunk_no"], r["so_far"]) for r in counts.collect()) == [(1, 0, 0), (1, 1, 4), (1, 2, 6), (2, 0, 0)]


def test_figure_captions_against_a_plain_loop(spark):
    draw, mark = random.Random(5), '<div class="figure-caption">x</div>'
    texts = []
    for n in (0, 1, 80, 400):
        gaps = ["y" * draw.choice([0, 1, 40, 300, 565, 566, 600, 900]) + draw.choice(["", "", mark]) for _ in range(n + 1)]
        texts.append("".join(f"{gap}__IMG_{draw.randrange(20000)}__" for gap in gaps[:n]) + gaps[n])

    def plain(html, before):
        out, last = "", 0
        for m in re.finditer("__IMG_[0-9]+__", html):
            out += html[last : m.end()]
            last = m.end()
            if 'class="figure-caption"' not in html[last : last + 600]:
                out += f'\n<div class="figure-caption">Figure {before + out.count("figure-caption") + 1}</div>'
        return out + html[last:]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
    found = [r[0] for r in rows.select("i", rw.with_figure_captions(F.col("html"), F.lit(3)).alias("y")).orderBy("i").select("y").collect()]
    assert found == [plain(t, 3) for t in texts]

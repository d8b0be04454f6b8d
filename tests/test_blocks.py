"""Post-processing of rewritten documents, case by case."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks, outlines

TITLE = '<h1 class="doc-title">'


@pytest.fixture(scope="module")
def run(spark):
    def processed(cases, scheme="decimal-nested", outline=None, source=None, images=None, **options):
        """Case name to (html, issues as {type: severity})."""
        rows = [(name, html, (images or {}).get(name)) for name, html in cases.items()]
        pages = spark.createDataFrame(rows, "doc_id string, html string, images array<string>")
        nodes = None
        if outline:
            headings = [(name, i, *h) for name, hs in outline.items() for i, h in enumerate(hs)]
            nodes = outlines.skeleton(spark.createDataFrame(headings, "doc_id string, pos int, level double, title string, number string"))
            nodes = outlines.skeleton_arrays(nodes)
        captions = None
        if source:
            captions = blocks.source_captions(spark.createDataFrame(list(source.items()), "doc_id string, html string"))
        once = blocks.post_processed(pages, scheme, nodes, captions, images="images", **options)
        first = {r["doc_id"]: (r["html"], {i["type"]: i["severity"] for i in r["issues"]}) for r in once.collect()}
        again = spark.createDataFrame([(n, h, (images or {}).get(n)) for n, (h, _) in first.items()], pages.schema)
        second = blocks.post_processed(again, scheme, nodes, captions, images="images", **options)
        assert {r["doc_id"]: r["html"] for r in second.collect()} == {n: h for n, (h, _) in first.items()}  # twice gives the same
        return first

    return processed


def test_split_and_splice(spark):
    texts = ["", "plain", "<p>a</p>", "x<h2 id=a>1. T</h2>\n<P>b\nc</P>y<div class=\"x figure-caption\">图1 z</div>", "<h2>open <h3>in</h3>", None, '<div class="other">q</div>']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, html string")
    assert {r["doc_id"]: r["html"] for r in blocks.splice(blocks.split(df)).collect()} == {i: t and re.sub("(?i)<(/?)P>", r"<\1P>" if t and "<P>" in t else r"<\1p>", t) for i, t in enumerate(texts)}
    kinds = [r["kind"] for r in blocks.split(df.where("doc_id = 3")).orderBy("pos").collect()]
    assert kinds == ["heading", "paragraph", "figure", None]


def test_titles_and_numbers(run):
    cases = {
        "later title": f"{TITLE}报告</h1><h2>5. 第一章</h2><p>a</p><h3>5.1 第一节</h3><p>b</p>{TITLE}另一个方案</h1><h2>5. 又一章</h2><p>c</p><h3>5.1 节二</h3>",
        "repeated title": f'{TITLE}平台</h1><p class="cover-meta">研究报告</p><h2>目标</h2><p>a</p><h2>架构</h2>{TITLE}平 台</h1> <p>研究报告</p><h2>功能</h2>{TITLE}平台</h1><p>正文</p><h2>总结</h2><h3>平台</h3>',
        "resets": "<h2>A</h2><h3>a1</h3><h4>a1x</h4><h3>a2</h3><h2>B</h2><h3>b1</h3>",
        "old numbers": "<h2>三、 旧号章</h2><h3>（五） 旧号节</h3><h2><strong>2. 粗</strong></h2><h2>2024年度总结</h2><h2>5G通信</h2>",
        "front matter": "<h1>T</h1><h2>1. 目录</h2><h2>摘要</h2><h3>研究背景</h3><h2>引言</h2><h2>关键词</h2><h2>致谢</h2><h3>人</h3>",
        "second language": f'{TITLE}中文</h1><h2 class="doc-title-en">English</h2><h2>引言</h2>',
        "captions": '<h2>章</h2><div class="figure-caption">图3 旧</div><div class="table-caption">表7 旧</div><div class="figure-caption a"><b>图1 旧</b></div><div class="figure-caption">表5 x</div>',
        "empty": "", "null": None,
    }
    got = {n: h for n, (h, _) in run(cases).items()}
    assert got["later title"] == f"{TITLE}报告</h1><h2>1. 第一章</h2><p>a</p><h3>1.1 第一节</h3><p>b</p><h2>2. 另一个方案</h2><h2>3. 又一章</h2><p>c</p><h3>3.1 节二</h3>"
    assert got["repeated title"] == f'{TITLE}平台</h1><p class="cover-meta">研究报告</p><h2>1. 目标</h2><p>a</p><h2>2. 架构</h2><h2>3. 功能</h2><p>正文</p><h2>4. 总结</h2>'
    assert got["resets"] == "<h2>1. A</h2><h3>1.1 a1</h3><h4>1.1.1 a1x</h4><h3>1.2 a2</h3><h2>2. B</h2><h3>2.1 b1</h3>"
    assert got["old numbers"] == "<h2>1. 旧号章</h2><h3>1.1 旧号节</h3><h2>2. <strong>粗</strong></h2><h2>3. 2024年度总结</h2><h2>4. 5G通信</h2>"
    assert got["front matter"] == "<h1>T</h1><h2>目录</h2><h2>摘要</h2><h3>研究背景</h3><h2>1. 引言</h2><h2>2. 关键词</h2><h2>致谢</h2><h3>2.1 人</h3>"
    assert got["second language"] == f'{TITLE}中文</h1><h2 class="doc-title-en">English</h2><h2>1. 引言</h2>'
    assert got["captions"] == '<h2>1. 章</h2><div class="figure-caption">图1 旧</div><div class="table-caption">表1 旧</div><div class="figure-caption a">图2 <b>旧</b></div><div class="figure-caption">图3 表5 x</div>'
    assert got["empty"] == "" and got["null"] is None


@pytest.mark.parametrize(
    "scheme, numbers, figures",
    [
        ("chinese-hierarchical", ["一、", "（一）", "1.", "(1)", "二、"], ["图1", "图2", "图3"]),
        ("chapter", ["第一章", "第一节", "一、", "1.1", "第二章"], ["图1", "图1-1", "图2-1"]),
        ("decimal", ["1.", "1.1", "1.1.1", "1.1.1.1", "2."], ["图1", "图1-1", "图2-1"]),
        ("none", None, ["图1", "图1-1", "图2-1"]),
    ],
)
def test_schemes(run, scheme, numbers, figures):
    titles = ["总则", "原则", "措施", "细则", "方法"]
    figure = '<div class="figure-caption">系统</div>'
    cases = {"a": f"<h2>目录</h2>{figure}" + "".join(f"<h{level}>{t}</h{level}>" for level, t in zip((2, 3, 4, 5), titles)) + figure + "<h2>方法</h2>" + figure}
    html, _ = run(cases, scheme, figure_relative=scheme != "chinese-hierarchical")["a"]
    assert re.findall("<h[2-6]>(.*?)</h", html)[1:] == [f"{n} {t}" for n, t in zip(numbers, titles)] if numbers else titles
    assert re.findall("图[0-9-]+", html) == figures and "<h2>目录</h2>" in html


def test_outline(run):
    three = [(1, "概述", "1"), (1, "架构", "2"), (1, "总结", "3")]
    six = [(1, t, "") for t in ("系统概述", "需求分析", "总体设计", "详细设计", "测试方案", "部署运维")]
    cases = {
        "extra": f"{TITLE}方案</h1><h2>概述</h2><p>a</p><h2>子项一</h2><h2>架构</h2><h2 data-sk=\"sk9\">子项二</h2><h2>总结</h2><p>e</p>",
        "level": f"{TITLE}T</h1><h2>主章</h2><h2>子节</h2>",
        "own numbers": f'{TITLE}T</h1><h2>引言</h2><h3>目的</h3><h2>设计</h2><div class="table-caption">表2-1 Table 2-1 成果</div><div class="figure-caption">无号</div>',
        "one missing": f"{TITLE}T</h1><h2>甲章</h2>", "many missing": f"{TITLE}T</h1><h2>系统概述</h2><h2>需求分析</h2>",
        "title in outline": f"{TITLE}关于XX的研究</h1><h2>引言</h2><h2>方法</h2>", "reworded": f"{TITLE}T</h1><h2>风场尾流效应的分析</h2><h2>结论</h2>",
        "same titles": "<h2>小结</h2><h2>小结</h2><h2>小结</h2>", "no outline": "<h2>A</h2>",
    }
    outline = {
        "extra": three, "level": [(1, "主章", "1"), (2, "子节", "1.1")], "own numbers": [(1, "引言", "2"), (2, "目的", "2.1"), (1, "设计", "3")], "one missing": [(1, "甲章", "1"), (1, "乙章", "2")],
        "many missing": six, "title in outline": [(1, "关于XX的研究", "1"), (1, "引言", ""), (1, "方法", "")], "reworded": [(1, "风场尾流效应分析", "1"), (1, "结论", "2")], "same titles": [(1, "小结", "1"), (2, "小结", "1.1")],
    }
    outline = {n: [(float(level), t, number) for level, t, number in hs] for n, hs in outline.items()}
    got = run(cases, outline=outline, keep_source_numbers=True)
    assert got["extra"][0] == f"{TITLE}方案</h1><h2>1. 概述</h2><p>a</p><h3>1.1 子项一</h3><h2>2. 架构</h2><h3>2.1 子项二</h3><h2>3. 总结</h2><p>e</p>"
    assert got["level"][0] == f"{TITLE}T</h1><h2>1. 主章</h2><h3>1.1 子节</h3>" and got["level"][1] == {}
    assert got["own numbers"][0] == f'{TITLE}T</h1><h2>2. 引言</h2><h3>2.1 目的</h3><h2>3. 设计</h2><div class="table-caption">表2-1 成果</div><div class="figure-caption">图1 无号</div>'
    assert got["one missing"][1] == {"heading_missing": "warning"} and got["many missing"][1] == {"heading_missing": "critical"}
    assert got["title in outline"][1] == {} and got["title in outline"][0].endswith("<h2>1. 引言</h2><h2>2. 方法</h2>")
    assert got["reworded"][1] == {} and "<h2>1. 风场尾流效应的分析</h2>" in got["reworded"][0]
    assert got["same titles"][0] == "<h2>1. 小结</h2><h3>1.1 小结</h3><h3>1.2 小结</h3>" and got["no outline"][0] == "<h2>1. A</h2>"


def test_captions_of_the_source(run):
    source = {
        "a": "<p>图1-1 总体架构</p><p>图 2.1： 数据流程图</p><table><caption>表3 成果清单 (list_a)</caption></table><p>图9 从未出现的图题</p>",
        "none": "<p>text</p>",
    }
    cases = {
        "a": '<h2>章</h2><p>图1-1 总体架构</p><div class="figure-caption">图5 不存在的图</div><div class="figure-caption">图2-1 数据流程</div><div class="table-caption">表3 成果清单</div>',
        "none": '<div class="figure-caption">图4 有</div>',
    }
    got = run(cases, source=source)
    assert got["a"][0] == '<h2>1. 章</h2><div class="figure-caption">图1-1 总体架构</div><div class="figure-caption">图 2.1： 数据流程图</div><div class="table-caption">表3 成果清单 (list_a)</div>'
    assert got["a"][1] == {"caption_pruned": "info", "caption_missing": "warning"}
    assert got["none"] == ('<div class="figure-caption">图1 有</div>', {})


def test_images(run):
    cases = {"twice": "<p>__IMG_0__</p><p>__IMG_0__</p>", "stray": '<h2>章</h2><img src="a.png"><p>x</p>', "fine": "<p>__IMG_0__</p><img>", "unknown": "__IMG_7__ __IMG_7__"}
    images = {"twice": ["__IMG_0__", "__IMG_1__"], "fine": ["__IMG_0__"], "unknown": []}
    got = run(cases, images=images)
    assert got["twice"][0] == f"<p>__IMG_0__</p><p></p>{blocks.IMAGES_LOST}<p>__IMG_1__</p>" and set(got["twice"][1]) == set() | {"image_missing", "image_duplicated"}
    assert got["stray"] == ("<h2>1. 章</h2><p>x</p>", {"image_hallucinated": "warning"})
    assert got["fine"] == ("<p>__IMG_0__</p><img>", {}) and got["unknown"] == ("__IMG_7__ __IMG_7__", {})


def test_anomalies(spark):
    rows = [
        (1, f'{TITLE}T</h1><h2 class="doc-title-en">E</h2><h2>a</h2>'), (2, f"{TITLE}T</h1>{TITLE}T</h1><h2>1. T</h2><h3>x</h3>"), (3, None), (4, "<h2>T</h2>"),
    ]
    got = {r["doc_id"]: (r["titles"], r["title_again"]) for r in blocks.anomalies(spark.createDataFrame(rows, "doc_id int, html string")).collect()}
    assert got == {1: (0, 0), 2: (2, 1), 3: (0, 0), 4: (0, 0)}


def test_caption_scores(spark):
    rows = [("图1 abcdef", "图1 abcdef", 42), ("图2 abcdef", "图1 abcdef", 30), ("图1 abcdefg", "图1 abcdef", 30), ("图1 abcdxf", "图1 abcdef", 12 + 12), ("图1 zzzzzz", "图1 abcdef", 12), ("图1", "图1", 28), ("图1 x", "图1", 6), ("图1", "图1 abc", 4)]
    from leafmill.functions.outlines import caption

    df = spark.createDataFrame(rows, "a string, b string, n int").select("n", caption(F.col("a")).alias("a"), caption(F.col("b")).alias("b"))
    for r in df.select("n", blocks.caption_score(F.col("a"), F.col("b")).alias("score")).collect():
        assert r["score"] == r["n"]

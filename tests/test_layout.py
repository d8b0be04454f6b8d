"""Lengths, spaces, levels of paragraphs, previews and tables of contents."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import layout
from leafmill.operators import previews, reports
from leafmill.sources import tables


def each(spark, rule, values):
    """What a rule gives for each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lengths(spark):
    size = F.lit(12.0)
    assert each(spark, layout.points, ["10.5pt", "large", None, "小四 12"]) == [10.5, 12, 12, 12]
    assert each(spark, lambda x: layout.spacing(x, size), ["6pt", "6磅", "1.5行", "0.5", "auto", "", None, "2行pt"]) == [120, 120, 540, 180, 0, 0, 0, 720]
    assert [tuple(r) for r in each(spark, layout.line_height, ["28PT", "1.5", " 2 ", "normal", "pt", None])] == [(560, True), (360, False), (480, False), (240, False), (240, False), (240, False)]
    assert each(spark, layout.millimetres, ["2.54cm", "1in", "30", "30 MM", "1.2.3", "", None]) == [25.4, 25.4, 30, 30, 1.2, 25.4, 25.4]


def test_indents(spark):
    found = each(spark, lambda x: layout.indent(x, F.lit(10.5)), ["2em", "21pt", "2字符", "ch", "0chars", "some", "0", "0px", "", None])
    assert [r and tuple(r) for r in found] == [(420, 200), (420, None), (420, 200), (420, 200), (420, 200), (480, 200), None, None, None, None]


def test_fonts_and_colors(spark):
    assert each(spark, layout.font, ["Arial, sans-serif", "'SimSun', serif", 'x, "Noto Serif"', "", None]) == ["Arial", "SimSun", "Noto Serif", "Times New Roman", "Times New Roman"]
    assert each(spark, layout.color, ["#ff0000", "ff0000", "", None]) == ["ff0000", "ff0000", "000000", "000000"]


@pytest.mark.parametrize(("before", "after"), [("中 文 字", "中文字"), ("用 Spark 写", "用Spark写"), ("a \t\n b", "a b"), ("x = 1 + ( y )", "x=1+(y)"), ("好， ok", "好，ok"), (" 中 ", " 中 "), ("", ""), (None, None)])
def test_closed_up(spark, before, after):
    assert each(spark, layout.closed_up, [before]) == [after]


@pytest.mark.parametrize(("text", "level"), [("第一章 总则", 1), ("第一章总则", None), ("第二节", 1), ("三、研究方法", 1), ("三、句子。", None), ("1. 引言", 1), ("1.2 背景", 1), ("（二）数据", 2), ("（3）样本", 3), ("（3）", None), ("正文", None), ("1、" + "长" * 100, None), ("", None), (None, None)])
def test_levels_by_text(spark, text, level):
    assert each(spark, lambda x: layout.paragraph_level(x, F.lit(None).cast("string"), F.lit(None).cast("int")), [text]) == [level]


def test_levels_by_style_and_outline(spark):
    rows = spark.createDataFrame([("Heading 2", 0), ("标题3", None), ("heading 12", 4), ("Body", None)], "style string, outline int")
    assert [r[0] for r in rows.select(layout.paragraph_level(F.lit("1. Text"), F.col("style"), F.col("outline"))).collect()] == [2, 3, 5, 1]


def test_lists_and_fonts(spark):
    assert each(spark, previews.joined_lists, ["<ol><li>a</li></ol>\n<ol><li>b</li></ol><p>x</p><ol></ol>"]) == ["<ol><li>a</li><li>b</li></ol><p>x</p><ol></ol>"]
    html = '<p style="font-size:1px;color:red;"><b\n STYLE="Font-Family: x; LINE-HEIGHT: 2">t</b><i style="">'
    assert each(spark, previews.without_fonts, [html, "no style", "", None]) == ['<p style="color:red"><b>t</b><i>', "no style", "", None]


def test_ids(spark):
    html = '<h1>a</h1><h2 id="x">b</h2><H3 class="c">c</H3><header>d</header>'
    assert each(spark, previews.with_ids, [html, "", None]) == ['<h1 id="toc-h-0">a</h1><h2 id="x">b</h2><H3 id="toc-h-1" class="c">c</H3><header>d</header>', "", None]
    many = "".join(f"<h2>{i}</h2>" for i in range(3000))
    assert each(spark, previews.with_ids, [many]) == ["".join(f'<h2 id="toc-h-{i}">{i}</h2>' for i in range(3000))]


def test_contents(spark):
    html = '<h1 class="DOC-TITLE">t</h1><h2 id="x">a &amp; <b>b</b></h2><h3> </h3><h3>c</h3><h4>open'
    assert [tuple(r) for r in each(spark, previews.contents, [html])[0]] == [("x", 2, "a & b"), ("toc-h-edit-1", 3, "c")]
    assert each(spark, previews.contents, ["", None]) == [[], None]


def test_heading_fingerprints(spark):
    html = "<h1>abcd</h1><h2> <b>abcd</b> </h2><h3>abc</h3><h2>第一章 引言</h2>"
    assert each(spark, previews.heading_fingerprints, [html, "", None]) == [["abcd", "第一章 引言"], [], None]


def test_lookup_reaches_the_scan(spark, capsys):
    found = reports.lookup(tables.users(spark, "/root/testdata/sf0.001"), name="Customer#000000042")
    found.explain("formatted")
    assert "EqualTo(c_name,Customer#000000042)" in capsys.readouterr().out
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, mail string")
    assert [r.id for r in reports.lookup(rows, mail=None).collect()] == [1]

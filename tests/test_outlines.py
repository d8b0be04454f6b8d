"""Outlines, captions and raw HTML on small cases worked out by hand."""

import datetime

from pyspark.sql import functions as F

from leafmill.functions import outlines as rules
from leafmill.operators import billing, outlines, structure


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_source_numbers(spark):
    got = lambda scheme: values(spark, lambda c: rules.source_number(c, scheme), "2.", "2.3", "2.3.4", "1.2.3.4", "IV", " ", None)
    assert got("decimal") == ["2.", "2.3", "2.3.4", "1.2.3.4", "IV", "", ""]
    assert got("chinese-hierarchical") == ["二、", "（三）", "4.", "(4)", "IV", "", ""]
    assert got("chapter") == ["第二章", "第三节", "四、", "4", "IV", "", ""]
    assert got("none")[:4] == ["", "", "", ""]


def test_captions(spark):
    got = values(spark, rules.caption, "<p>图 1.2　系统 A（v_1）</p>", "表3:Costs", "Figure 1", None)
    assert [tuple(c) if c else None for c in got] == [("图", "1-2", "系统 A（v_1）", "系统a"), ("表", "3", "Costs", "costs"), None, None]


def test_formula_blocks_and_contents(spark):
    assert values(spark, rules.clean_output, "```html\n<div>$$a\nb$$</div>\n<div>$$a\nb$$</div>```", "<p>$a$</p><p>$b$</p>") == ["<div>$$a\nb$$</div>", "<p>$a$</p><p>$b$</p>"]
    assert values(spark, rules.without_contents, '<p><a href="#_Toc1">x</a></p>y<a id="z"></a>', '<p><a href="#other">x</a></p>') == ["y", '<p><a href="#other">x</a></p>']


def test_xml_trailers_and_images(spark):
    assert values(spark, rules.xml_fields, "<xml><a><![CDATA[<1>]]></a><b> 2 </b><a>3</a></xml>", "no xml") == [{"a": "3", "b": "2"}, {}]
    got = values(spark, rules.trailer, "x" + rules.TRAILER + '[{"level":1,"text":"t"}]', "x" + rules.TRAILER, "x")
    assert [r.text for r in got] == ["x", "x", "x"] and got[0].headings[0].text == "t" and got[2].headings is None
    out = values(spark, rules.images_out, "<img src='a'><p>$1</p><img alt='b' src=\"\\c\">", "none", "")
    assert [o.text for o in out] == ["__IMG_0__<p>$1</p>__IMG_1__", "none", ""]
    back = lambda c: rules.images_back(rules.images_out(c)["text"], rules.images_out(c)["images"])
    assert values(spark, back, "<img src='a'><p>$1</p><img alt='b' src=\"\\c\">", "__IMG_7__") == ["<img src='a'><p>$1</p><img alt='b' src=\"\\c\">", "__IMG_7__"]


def test_times(spark):
    df = spark.createDataFrame([(datetime.date(2024, 3, 31), datetime.datetime(2024, 2, 29, 9, 0))], "d date, t timestamp_ntz")
    row = df.select(rules.months_back(F.col("d"), 1).alias("d"), rules.next_nine(F.col("t")).alias("t")).first()
    assert (row.d, row.t) == (datetime.date(2024, 3, 2), datetime.datetime(2024, 3, 1, 9, 0))


def test_skeleton_and_titles(spark):
    rows = [(1, 0, 1.0, "", "Title"), (1, 1, 1.6, "1", "1. Chapter"), (1, 2, 1.0, None, " title "), (1, 3, 0.0, "", "bad"), (1, 4, 1.0, "", "  "), (1, 5, 9.0, "", "deep"), (1, 6, 1.0, "", "致谢")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, level double, number string, title string")
    nodes = outlines.skeleton(df)
    assert [(r.node, r.level, r.norm) for r in nodes.orderBy("node").collect()] == [("sk0", 2, "Title"), ("sk1", 3, "Chapter"), ("sk2", 2, "title"), ("sk3", 6, "deep"), ("sk4", 2, "致谢")]
    assert tuple(outlines.outline_totals(nodes).first()) == (1, 2, False)
    kept = outlines.single_title(df.withColumn("level", F.col("level").cast("int")))
    assert [(r.pos, r.level) for r in kept.orderBy("pos").collect()] == [(0, 1), (1, 2), (3, 0), (4, 2), (5, 9), (6, 2)]
    assert outlines.last_headings(df.where("pos < 3"), n=2).first().headings == "1. Chapter -> title"


def test_counts_of_odd_tags(spark):
    df = spark.createDataFrame([("<p\n>a</p><img/><li>( 3 )（4）<pre><table\tx><h2 class='doc-title'>t</h2><h3>u</h3>",)], "html string")
    row = df.select(*structure.counts(F.col("html"))).first()
    assert (row.paragraphs, row.headings, row["items"], row.images, row.tables) == (1, 1, 2, 1, 1)


def test_refunds_count_uses_of_the_day_and_later(spark):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    orders = spark.createDataFrame([(1, 7, "PAID", at(2, 5)), (2, 7, "PAID", at(4, 5)), (3, 8, "PAID", at(1, 0)), (4, 7, "PENDING", at(1, 0)), (5, None, "PAID", at(1, 0)), (6, 7, "PAID", at(2, 6))], "id int, user_id int, status string, ts timestamp_ntz")
    log = spark.createDataFrame([(7, "view", at(2, 4)), (7, "view", at(2, 5)), (7, "view", at(2, 6)), (7, "view", at(3, 0)), (7, "click", at(9, 0)), (None, "view", at(9, 0))], "user_id int, action string, ts timestamp_ntz")
    got = {r.id: (r.later_uses, r.refundable) for r in billing.refundable(orders, log, "view").collect()}
    assert got == {1: (3, False), 2: (0, True), 3: (0, True), 5: (0, True), 6: (2, False)}


def test_many_placeholders_stay_linear(spark):
    html = "".join(f'<p>{i}</p><img src="{i}">' for i in range(20_000)) + "__IMG_99999__"
    taken = spark.createDataFrame([(html,)], "html string").select("html", rules.images_out(F.col("html")).alias("o"))
    assert taken.select(F.col("html") == rules.images_back(F.col("o.text"), F.col("o.images"))).first()[0]

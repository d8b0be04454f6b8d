"""Queries over outlines, captions, trailers and raw HTML, with their SQL.

The SQL states what each rule has to give for inputs that are made from the
supplied rows so that every branch is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import outlines as rules
from leafmill.operators import outlines
from leafmill.plans.operations import ORDERS, USAGE, USERS
from leafmill.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


TITLE = "CASE id % 10 WHEN 0 THEN '摘 要' WHEN 1 THEN '致谢' WHEN 2 THEN (id % 9 + 1) || '. ' || plan WHEN 3 THEN '  ' ELSE plan END"
NORM = "CASE id % 10 WHEN 0 THEN '摘要' WHEN 1 THEN '致谢' WHEN 3 THEN '' ELSE lower(replace(plan, ' ', '')) END"
NORM_AS_WRITTEN = NORM.replace("lower(replace(plan, ' ', ''))", "replace(plan, ' ', '')")
NUMBER = "CASE WHEN id % 3 < 2 THEN (id % 4 + 1) || '.2' ELSE '' END"


def headings(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """(doc_id, pos, level, number, title): a user's orders as the headings of a document."""
    return tables.orders(spark, sf_dir).selectExpr("user_id AS doc_id", "id AS pos", f"{level} AS level", f"{NUMBER} AS number", f"{TITLE} AS title")


NODES = f"SELECT *, 'sk' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS node FROM (SELECT user_id AS doc_id, id AS pos, CAST(least(least(id % 8, 6) + 1, 6) AS INTEGER) AS level, {NUMBER} AS number, {NORM_AS_WRITTEN} AS norm FROM {ORDERS} WHERE id % 8 >= 1 AND id % 10 <> 3)"


@query(f"SELECT doc_id, node, level, number, norm FROM ({NODES})")
def skeleton_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.skeleton(headings(spark, sf_dir, "id % 8 + 0.25")).select("doc_id", "node", "level", "number", "norm")


@query(f"SELECT doc_id, count(*) FILTER (WHERE level = 2 AND norm NOT IN ('摘要', '致谢')) AS chapters, avg(CASE WHEN number <> '' THEN 1 ELSE 0 END) >= 0.7 AS keeps_numbers FROM ({NODES}) GROUP BY 1")
def outline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.outline_totals(outlines.skeleton(headings(spark, sf_dir, "id % 8 + 0.25")))


@query(f"""WITH r AS (SELECT user_id AS doc_id, id AS pos, id % 3 + 1 AS level, {TITLE} AS title, {NORM} AS norm FROM {ORDERS}),
t AS (SELECT doc_id, min(pos) AS pos, arg_min(norm, pos) AS norm FROM r WHERE level = 1 GROUP BY 1)
SELECT r.doc_id, r.pos, CAST(CASE WHEN level = 1 AND r.pos > t.pos THEN 2 ELSE level END AS INTEGER) AS level, title FROM r LEFT JOIN t ON t.doc_id = r.doc_id
WHERE NOT (level = 1 AND r.pos > t.pos AND r.norm = t.norm AND t.norm <> '')""")
def single_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.single_title(headings(spark, sf_dir, "CAST(id % 3 + 1 AS INT)"))


@query(f"SELECT doc_id, string_agg(trim(title), ' -> ' ORDER BY pos) AS headings FROM (SELECT user_id AS doc_id, id AS pos, {TITLE} AS title, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM {ORDERS}) WHERE r <= 5 GROUP BY 1")
def last_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.last_headings(headings(spark, sf_dir, "1"))


@query(f"SELECT doc_id, lower(trim(title)) AS title, arg_max(level, pos) AS level, arg_max(number, pos) AS number FROM (SELECT user_id AS doc_id, id AS pos, CAST(id % 3 + 1 AS INTEGER) AS level, {NUMBER} AS number, {TITLE} AS title FROM {ORDERS}) GROUP BY 1, 2")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.heading_levels(headings(spark, sf_dir, "CAST(id % 3 + 1 AS INT)"))


NUMERALS = "['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一']"


@query(f"""SELECT id, CASE d WHEN 0 THEN 'A' WHEN 1 THEN a || '.' WHEN 2 THEN a || '.' || b WHEN 3 THEN a || '.' || b || '.3' WHEN 4 THEN a || '.' || b || '.3.' || a ELSE '' END AS decimal,
CASE d WHEN 0 THEN 'A' WHEN 1 THEN {NUMERALS}[a] || '、' WHEN 2 THEN '（' || {NUMERALS}[b] || '）' WHEN 3 THEN '3.' WHEN 4 THEN '(' || a || ')' ELSE '' END AS chinese,
CASE d WHEN 0 THEN 'A' WHEN 1 THEN '第' || {NUMERALS}[a] || '章' WHEN 2 THEN '第' || {NUMERALS}[b] || '节' WHEN 3 THEN '三、' WHEN 4 THEN '' || a ELSE '' END AS chapter
FROM (SELECT id, id % 6 AS d, CAST(id % 11 + 1 AS INTEGER) AS a, CAST(id % 7 + 1 AS INTEGER) AS b FROM {USERS})""")
def source_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "CASE id % 6 WHEN 0 THEN 'A' WHEN 1 THEN a || '. ' WHEN 2 THEN concat_ws('.', a, b) WHEN 3 THEN concat_ws('.', a, b, '3') WHEN 4 THEN concat_ws('.', a, b, '3', a) END AS number"
    users = tables.users(spark, sf_dir).selectExpr("id", "string(id % 11 + 1) AS a", "string(id % 7 + 1) AS b").selectExpr("id", number)
    schemes = {"decimal": "decimal", "chinese": "chinese-hierarchical", "chapter": "chapter"}
    return users.select("id", *(rules.source_number(F.col("number"), scheme).alias(c) for c, scheme in schemes.items()))


@query(f"""SELECT id, CASE id % 3 WHEN 0 THEN '图' WHEN 1 THEN '表' END AS kind, CASE WHEN id % 3 < 2 THEN CASE WHEN id % 2 = 0 THEN '' || (id % 9) ELSE (id % 9) || '-' || (id % 5) END END AS number,
CASE WHEN id % 3 < 2 THEN plan || ' (fig_' || id || ')' END AS title, CASE WHEN id % 3 < 2 THEN regexp_replace(lower(plan), '[^a-z0-9]', '', 'g') END AS key FROM {ORDERS}""")
def captions_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = "element_at(array('<b>图', '表 ', 'Chart '), int(id % 3 + 1))", "if(id % 2 = 0, string(id % 9), concat(id % 9, if(id % 4 = 1, '.', '-'), id % 5))"
    lines = tables.orders(spark, sf_dir).selectExpr("id", f"concat({kind}, {number}, element_at(array('&nbsp;', '：', '、', '. '), int(id % 4 + 1)), plan, ' (fig_', id, ')</b>') AS line")
    return lines.select("id", rules.caption(F.col("line")).alias("c")).select("id", "c.kind", "c.number", "c.title", "c.key")


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN '<p>$x_' || id || '$</p>' ELSE '<p>$x_' || id || '$</p> <p>$y_' || id || '$</p>' END AS html FROM {USERS}")
def cleaned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('```html\n<p>$x_', id, '$</p> <p>$', if(id % 3 = 0, 'x', 'y'), '_', id, '$</p>\n```') AS t"
    return tables.users(spark, sf_dir).selectExpr("id", text).select("id", rules.clean_output(F.col("t")).alias("html"))


@query("SELECT page_id, md5(html) AS hash FROM pages")
def contents_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages come out as they were once a table of contents and anchors have been put in and cleaned away."""
    link = F.lit('<p class="toc"> <a href="#_Toc12">1 <b>x</b></a> </p>')
    html = F.concat(link, link, F.col("html"), F.lit('<a id="_Hlk3"></a>'))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(rules.without_contents(html).cast("binary")).alias("hash"))


@query(f"SELECT id, CAST(id AS VARCHAR) AS number, status, plan, CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END AS twice, 2 + CAST(id % 2 = 0 AS INTEGER) AS n FROM (SELECT id, status, plan FROM {ORDERS})")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written as XML is read again; of a repeated field the last counts."""
    xml = rules.to_xml(F.create_map(F.lit("number"), F.col("id").cast("string"), F.lit("status"), F.col("status")))
    plain = F.concat(F.lit("<plan> "), F.col("plan"), F.lit("</plan><twice>a</twice>"), F.when(F.col("id") % 2 == 0, "<twice><![CDATA[b]]></twice>").otherwise(""))
    fields = tables.orders(spark, sf_dir).select("id", rules.xml_fields(F.concat(F.substring(xml, F.lit(6), F.length(xml) - 11), plain)).alias("f"), F.when(F.col("id") % 2 == 0, 3).otherwise(2).alias("n"))
    return fields.select("id", *(F.col("f")[c].alias(c) for c in ("number", "status", "plan", "twice")), "n")


@query("SELECT doc_id, length(coalesce(text, '')) AS chars, CASE doc_id % 3 WHEN 0 THEN 2 END AS n FROM documents")
def trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a trailer, with one that can't be read, and without."""
    listed = F.lit('[{"level":1,"text":"a","number":""},{"level":2,"text":"b"}]')
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(rules.TRAILER), listed)).when(F.col("doc_id") % 3 == 1, rules.TRAILER + "[{").otherwise("")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rules.trailer(F.concat(F.coalesce("text", F.lit("")), end)).alias("t"))
    return d.select("doc_id", F.length("t.text").cast("long").alias("chars"), F.when(F.col("doc_id") % 3 == 0, F.size("t.headings")).alias("n"))


@query("SELECT page_id, CAST(page_id % 4 AS INTEGER) AS images, md5(html || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '__IMG_0__' WHEN 2 THEN '__IMG_0__x__IMG_1__' ELSE '__IMG_0__x__IMG_1__x__IMG_2__' END || '__IMG_99__') AS without, true AS restored FROM pages")
def image_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images out of pages and back into them; a placeholder that stood there before stays."""
    own = F.transform(F.sequence(F.lit(1), F.col("page_id").cast("int") % 4), lambda i: F.concat(F.lit('<IMG alt="$1" src="data:'), i.cast("string"), F.lit('">')))
    images = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.array_join(own, "x"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", images, F.lit("__IMG_99__")).alias("full"))
    out = pages.withColumn("o", rules.images_out(F.col("full")))
    restored = rules.images_back(F.col("o.text"), F.col("o.images")) == F.col("full")
    return out.select("page_id", F.size("o.images").alias("images"), F.md5(F.col("o.text").cast("binary")).alias("without"), restored.alias("restored"))


@query(f"SELECT id, ['a' || id || 'x&y', lower(replace(name, ' ', ''))] AS keys FROM {USERS}")
def table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<p>t</p><table border=1>\n<tr><td>A&nbsp;"), F.col("id").cast("string"), F.lit("</td> <td>x &amp;Y</td></tr></table> - <TABLE>"), F.col("name"), F.lit("</TABLE>"))
    return tables.users(spark, sf_dir).select("id", rules.table_keys(html).alias("keys"))


@query(f"SELECT id, id % 2 = 0 AND id % 5 >= 2 AS alternates FROM {USAGE}")
def alternating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 to 10 lines in which two (or three) take turns, with short ones between them."""
    kinds = F.when(F.col("id") % 2 == 0, 2).otherwise(3)
    line = lambda i: F.concat(F.lit("an introductory sentence, number "), (i % kinds).cast("string"))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), (F.col("id") % 5 + 5).cast("int")), lambda i: F.array(line(i), F.lit("short"))))
    return tables.usage_log(spark, sf_dir).select("id", rules.alternates(lines).alias("alternates"))


@query(f"SELECT id, CAST(date_trunc('month', ts) - INTERVAL 3 MONTH AS DATE) + CAST(day(ts) - 1 AS INTEGER) AS since, CAST(CAST(ts AS DATE) + CASE WHEN hour(ts) < 9 THEN 0 ELSE 1 END AS TIMESTAMP) + INTERVAL 9 HOUR AS next_run FROM {USAGE}")
def schedule_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usage_log(spark, sf_dir).select("id", rules.months_back(F.to_date("ts"), 3).alias("since"), rules.next_nine(F.col("ts")).alias("next_run"))

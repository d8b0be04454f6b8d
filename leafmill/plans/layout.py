"""Queries over laid-out text, previews and tables of contents, with their SQL.

Their inputs are the supplied texts, pages and lines, written so that each rule has something to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import layout
from leafmill.operators import previews, reports
from leafmill.plans.documents import plain
from leafmill.plans.operations import USERS
from leafmill.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: A page's links as headings in lists of one item each, some with ids of their own; styles on paragraphs; a title on some pages.
HTML = """replace(replace(replace(replace(replace(replace(html,
'<ul>', '<ol>'), '</ul>', '</ol>'), '<li>', '<li><h3>'), '</li>', '</h3></li>'), '</li><li>', '</li></ol> <ol><li>'), '<h3><a href="/the">', '<h3 id="the"><a href="/the">')"""
STYLED = f"""replace(replace({HTML}, '<h1>', CASE page_id % 4 WHEN 0 THEN '<h1 class="Doc-Title top">' ELSE '<h1>' END),
'<p>', CASE page_id % 3 WHEN 0 THEN '<p style="Font-Size: 12px; color: red">' WHEN 1 THEN '<p STYLE="line-height:2;">' ELSE '<p>' END)"""
OPENING = r"<h[1-6](?:\s[^>]*)?>"
UNSTYLED = f"""replace(replace(regexp_replace({STYLED}, '</ol>\\s*<ol>', '', 'g'), '<p style="Font-Size: 12px; color: red">', '<p style="color: red">'), '<p STYLE="line-height:2;">', '<p>')"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{STYLED} AS html")


@query(f"""WITH h AS (SELECT page_id, {UNSTYLED} AS html FROM pages),
parts AS (SELECT page_id, unnest(regexp_split_to_array(html, '{OPENING}')) AS part, unnest(list_prepend('', regexp_extract_all(html, '{OPENING}'))) AS tag, unnest(range(len(regexp_extract_all(html, '{OPENING}')) + 1)) AS pos FROM h),
ids AS (SELECT *, tag NOT LIKE '%id=%' AND pos > 0 AS bare, count(*) FILTER (WHERE tag NOT LIKE '%id=%' AND pos > 0) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM parts)
SELECT page_id, string_agg(CASE WHEN bare THEN substr(tag, 1, 3) || ' id="toc-h-' || n || '"' || substr(tag, 4) ELSE tag END || part, '' ORDER BY pos) AS html FROM ids GROUP BY 1""")
def preview_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styled(spark, sf_dir).select("page_id", previews.preview(F.col("html")).alias("html"))


WHOLE = r"(?is)<h([1-6])\b([^>]*)>(.*?)</h[1-6]>"
EVERY = f"(SELECT page_id, unnest(range(len(regexp_extract_all(html, '{WHOLE}')))) AS pos, unnest(regexp_extract_all(html, '{WHOLE}', 1)) AS level, unnest(regexp_extract_all(html, '{WHOLE}', 2)) AS attrs, unnest(regexp_extract_all(html, '{WHOLE}', 3)) AS text FROM (SELECT page_id, {STYLED} AS html FROM pages))"


@query(f"""SELECT page_id, pos, CASE WHEN attrs LIKE '% id=%' THEN 'the' ELSE 'toc-h-edit-' || pos END AS id, level, text
FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, attrs, CAST(level AS INTEGER) AS level, {plain('text')} AS text FROM {EVERY} WHERE {plain('text')} <> '' AND attrs NOT LIKE '%Doc-Title%')""")
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = styled(spark, sf_dir).select("page_id", F.posexplode(previews.contents(F.col("html"))).alias("pos", "h"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "h.id", "h.level", "h.text")


@query(f"SELECT DISTINCT page_id, text FROM (SELECT page_id, regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM {EVERY}) WHERE length(text) >= 4")
def heading_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styled(spark, sf_dir).select("page_id", F.explode(previews.heading_fingerprints(F.col("html"))).alias("text"))


MARKS = ["第二章 ", "三、", "4. ", "（五）", "6.1 ", "（7）", "8.1.2 ", "", "第九章"]
LINES = ("split_part(line, '.', 1)", "CASE pos % 11 WHEN 1 THEN 'heading 3' WHEN 5 THEN '标题 12' END", "CASE pos % 7 WHEN 3 THEN doc_id % 4 END")
LEVELS = " ".join(f"WHEN regexp_matches(own, '{pattern}') THEN {level}" for level, pattern in layout.PARAGRAPHS)


@query(f"""WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, pos, trim({MARKS}[(doc_id + pos) % {len(MARKS)} + 1] || {LINES[0]}) AS own, {LINES[1]} AS style, {LINES[2]} AS outline FROM lines)
SELECT doc_id, pos, CAST(coalesce(CASE style WHEN 'heading 3' THEN 3 END, outline + 1, CASE WHEN length(own) <= {layout.LONGEST} THEN CASE {LEVELS} END END) AS INTEGER) AS level FROM p""")
def paragraph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text, style, outline = (F.expr(x) for x in LINES)
    mark = F.element_at(F.array(*map(F.lit, MARKS)), ((F.col("doc_id") + F.col("pos")) % len(MARKS) + 1).cast("int"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), layout.paragraph_level(F.concat(mark, text), style, outline).alias("level"))


def closed(x: str) -> str:
    """Twice each, as matches that share a character are found in turn."""
    x = f"regexp_replace({x}, '[\\n\\r\\t\\x0B\\f \\x{{A0}}\\x{{3000}}]+', ' ', 'g')"
    for pattern in [f"({layout.IDEOGRAPH}) ([^ ])"] * 2 + [f"([^ ]) ({layout.IDEOGRAPH})"] * 2:
        x = f"regexp_replace({x}, '{pattern}', '\\1\\2', 'g')"
    return f"regexp_replace({x}, ' ?({layout.SIGNS}) ?', '\\1', 'g')"


WIDE = "translate(text, ',.;', '，。=')"


@query(f"SELECT doc_id, {closed(WIDE)} AS text FROM documents")
def closed_up_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", layout.closed_up(F.expr(WIDE)).alias("text"))


UNITS = ["pt", "磅", "行", "em", " chars", "cm", "IN", "px", " mm"]
LENGTH = "CASE l_partkey % 17 WHEN 0 THEN '0' WHEN 1 THEN 'auto' WHEN 2 THEN '0字符' WHEN 3 THEN '' ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '.', CAST(l_partkey % 10 AS STRING), unit) END"


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey % 5 + 10.5::DOUBLE AS size, {LENGTH} AS length FROM (SELECT *, {UNITS}[l_suppkey % {len(UNITS)} + 1] AS unit FROM lineitem)),
v AS (SELECT *, TRY_CAST(regexp_extract(length, '[0-9]+([.][0-9]+)?') AS DOUBLE) AS v, length LIKE '%pt' OR length LIKE '%磅' AS exact FROM l)
SELECT l_orderkey, length, coalesce(v, 12) AS points, CAST(coalesce(floor(CASE WHEN exact THEN v * 20 ELSE v * size * 30 END + 0.5), 0) AS BIGINT) AS spacing,
CAST(coalesce(floor(CASE WHEN exact THEN v * 20 ELSE v * 240 END + 0.5), 240) AS BIGINT) AS line, exact AND v IS NOT NULL AS exact,
CAST(CASE WHEN length IN ('', '0') THEN NULL WHEN length LIKE '%em' THEN floor(v * size * 20 + 0.5) WHEN length LIKE '%pt' THEN floor(v * 20 + 0.5) WHEN length LIKE '%ch%' OR length LIKE '%字符' THEN floor(coalesce(nullif(v, 0), 2) * size * 20 + 0.5) ELSE 480 END AS BIGINT) AS first_line,
CAST(CASE WHEN length IN ('', '0') OR length LIKE '%pt' THEN NULL WHEN length LIKE '%em' THEN floor(v * 100 + 0.5) WHEN length LIKE '%ch%' OR length LIKE '%字符' THEN floor(coalesce(nullif(v, 0), 2) * 100 + 0.5) ELSE 200 END AS BIGINT) AS chars,
coalesce(v * CASE WHEN length LIKE '%cm' THEN 10 WHEN length LIKE '%IN' THEN 25.4::DOUBLE ELSE 1 END, 25.4) AS mm FROM v""")
def style_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_suppkey") % len(UNITS) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("unit", unit).select("l_orderkey", F.expr(LENGTH).alias("length"), (F.col("l_partkey") % 5 + F.lit(10.5)).alias("size"))
    length, size = F.col("length"), F.col("size")
    line, first = layout.line_height(length), layout.indent(length, size)
    return rows.select("l_orderkey", "length", layout.points(length).alias("points"), layout.spacing(length, size).alias("spacing"), line["line"].alias("line"), line["exact"].alias("exact"), first["first_line"].alias("first_line"), first["chars"].alias("chars"), layout.millimetres(length).alias("mm"))


@query(f"SELECT id, name, tier, balance FROM {USERS} WHERE name = 'Customer#000000042'")
def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lookup(tables.users(spark, sf_dir), name="Customer#000000042")

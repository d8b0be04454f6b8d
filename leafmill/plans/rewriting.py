"""Queries over rewritten documents, with their SQL: outlines, captions, tables, chunks, official documents, pages.

The rewritten documents are made from the supplied texts and pages so that each
rule has something to do; the SQL states what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import outlines as rules
from leafmill.operators import blocks, outlines, rewriting
from leafmill.plans.documents import compact, counts, n, pages
from leafmill.plans.operations import ORDERS
from leafmill.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: SQL: the letters of each line of a text, lines without any left out, numbered from 1 (r).
LINES = """l AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, t FROM (SELECT doc_id, source, i, trim(substr(regexp_replace(regexp_replace(x, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'), 1, 40)) AS t
FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)) WHERE t <> '')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, ts): the same lines as an array."""
    # [^A-Za-z ] takes Java ten times as long
    made = r"filter(transform(split(coalesce(text, ''), '\n'), x -> trim(substr(regexp_replace(regexp_replace(x, '[^\\p{Alpha} ]+', ''), '  +', ' '), 1, 40))), x -> x != '')"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source", f"{made} AS ts")


def joined(case: str) -> str:
    """A Spark SQL expression: the lines as HTML, by a case over a line ``t`` and its number ``r``."""
    return f"array_join(transform(ts, (t, j) -> {case.replace('{r}', '(j + 1)')}), '')"


@query(f"""WITH {LINES}, c AS (SELECT *, count(*) FILTER (WHERE r % 5 IN (1, 3)) OVER (PARTITION BY doc_id ORDER BY r) AS c1 FROM l),
d AS (SELECT *, count(*) FILTER (WHERE r % 5 = 2) OVER w AS c2, count(*) FILTER (WHERE r % 5 = 4) OVER w AS f FROM c WINDOW w AS (PARTITION BY doc_id, c1 ORDER BY r)),
h AS (SELECT doc_id, string_agg(CASE r % 5 WHEN 2 THEN '<h3>' || c1 || '.' || c2 || ' ' || t || '</h3>' WHEN 4 THEN '<div class="figure-caption">图' || c1 || '-' || f || ' ' || t || '</div>' WHEN 0 THEN '<p>' || t || '</p>' ELSE '<h2>' || c1 || '. ' || t || '</h2>' END, '' ORDER BY r) AS b FROM d GROUP BY 1)
SELECT doc_id, md5('<h1 class="doc-title">' || source || '</h1><h2>目录</h2>' || coalesce(b, '')) AS hash, 0 AS issues FROM documents LEFT JOIN h USING (doc_id)""")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale numbers, titles in the middle, front matter, captions by chapter, the title once more at the end."""
    body = joined("CASE {r} % 5 WHEN 1 THEN concat('<h2>7. ', t, '</h2>') WHEN 2 THEN concat('<h3>（五） ', t, '</h3>') WHEN 3 THEN concat('<h1 class=\"doc-title\">', t, '</h1>') WHEN 4 THEN concat('<div class=\"figure-caption\">图9 ', t, '</div>') ELSE concat('<p>', t, '</p>') END")
    html = f"concat('<h1 class=\"doc-title\">', source, '</h1><h2>1. 目录</h2>', {body}, '<h1>', source, '</h1> <p>研究报告</p>') AS html"
    done = blocks.post_processed(lines(spark, sf_dir).selectExpr("doc_id", html), "decimal-nested", figure_relative=True)
    return done.select("doc_id", F.md5(F.col("html").cast("binary")).alias("hash"), F.size("issues").alias("issues"))


@query(f"""WITH {LINES}, v AS (SELECT *, CASE WHEN r % 4 = 0 THEN 3 ELSE r % 3 + 2 END AS level, CASE WHEN r % 4 = 0 THEN 'Extra ' || r ELSE t || ' n' || r END AS title FROM l),
c AS (SELECT *, count(*) FILTER (WHERE level = 2) OVER (PARTITION BY doc_id ORDER BY r) AS c1 FROM v), d AS (SELECT *, count(*) FILTER (WHERE level = 3) OVER (PARTITION BY doc_id, c1 ORDER BY r) AS c2 FROM c),
e AS (SELECT *, count(*) FILTER (WHERE level = 4) OVER (PARTITION BY doc_id, c1, c2 ORDER BY r) AS c3 FROM d),
h AS (SELECT doc_id, count(*) FILTER (WHERE r % 4 = 0) AS demoted, string_agg('<h' || level || '>' || CASE WHEN level = 2 THEN c1 || '. ' WHEN c1 = 0 THEN '' WHEN level = 3 THEN c1 || '.' || c2 || ' ' ELSE c1 || '.' || c2 || '.' || c3 || ' ' END || title || '</h' || level || '>', '' ORDER BY r) AS b FROM e GROUP BY 1)
SELECT doc_id, md5(coalesce(b, '')) AS hash, coalesce(demoted, 0) AS demoted FROM documents LEFT JOIN h USING (doc_id)""")
def outline_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings came as chapters, every fourth isn't in the outline: levels follow the outline, the others go one down."""
    title = "CASE WHEN {r} % 4 = 0 THEN concat('Extra ', {r}) ELSE concat(t, ' n', {r}) END"
    rows = lines(spark, sf_dir)
    html = rows.selectExpr("doc_id", joined(f"concat('<h2>9. ', {title}, '</h2>')") + " AS html")
    listed = rows.selectExpr("doc_id", "posexplode(ts) AS (pos, t)").where("(pos + 1) % 4 != 0")
    nodes = outlines.skeleton(listed.selectExpr("doc_id", "pos", "(pos + 1) % 3 + 1 AS level", "'' AS number", "concat(t, ' n', pos + 1) AS title"))
    done = blocks.post_processed(html, "decimal-nested", outlines.skeleton_arrays(nodes))
    demoted = F.coalesce(F.get(F.transform(F.filter("issues", lambda i: i["type"] == "heading_demoted"), lambda i: i["n"]), F.lit(0)), F.lit(0))
    return done.select("doc_id", F.md5(F.col("html").cast("binary")).alias("hash"), demoted.alias("demoted"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, string_agg(CASE WHEN r % 3 <> 0 THEN '<div class="figure-caption">图' || r || ' ' || t || md5('' || r) || '</div>' ELSE '' END, '' ORDER BY r) AS b, count(*) FILTER (WHERE r % 3 = 0) AS missing, count(*) FILTER (WHERE r % 4 = 0) AS pruned FROM l GROUP BY 1)
SELECT doc_id, md5(b) AS hash, missing, pruned FROM h""")
def caption_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten document lost every third caption, changed each one's case, and has one of its own after every fourth line."""
    # lines are made and sent once for both; a join by doc_id asks for it not to be null, so that is said of both.
    # Lines are short beside what is made of them: parts merged by their size would be too few
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines(spark, sf_dir).select("doc_id", "ts").where("doc_id IS NOT NULL").repartition(parts, "doc_id")
    own = "concat('图', {r}, ' ', t, md5(string({r})))"
    source = blocks.source_captions(rows.selectExpr("doc_id", joined(f"concat('<p>', {own}, '</p>')") + " AS html"))
    invented = "if({r} % 4 = 0, concat('<div class=\"figure-caption\">图', {r} + 9000, ' ', sha1(string({r})), '</div>'), '')"
    output = rows.selectExpr("doc_id", joined(f"concat(if({{r}} % 3 = 0, '', concat('<div class=\"figure-caption\">', upper({own}), '</div>')), {invented})") + " AS html")
    html = blocks.splice(blocks.to_captions(blocks.split(output), source), "doc_id", "caption").where("caption IS NOT NULL")
    return html.select("doc_id", F.md5(F.col("html").cast("binary")).alias("hash"), F.col("caption.missing").cast("long").alias("missing"), F.col("caption.pruned").cast("long").alias("pruned"))


@query(f"""WITH c AS (SELECT id, CASE WHEN id % 2 = 0 THEN '图' ELSE '表' END AS kind, '' || id % 4 AS number, plan, CASE WHEN id % 3 = 0 THEN '' ELSE regexp_replace(lower(plan), '[^a-z0-9]', '', 'g') END AS key, lead(id) OVER (ORDER BY id) AS other FROM {ORDERS}),
p AS (SELECT a.id, a.kind = b.kind AND a.number = b.number AS same, a.key AS c, b.key AS e, 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key), 1) AS s FROM c a JOIN c b ON b.id = a.other)
SELECT id, CASE WHEN same THEN 12 ELSE 0 END + CASE WHEN e = '' THEN CASE WHEN c = '' THEN 16 ELSE -6 END WHEN c = '' THEN -8 WHEN c = e THEN 30 WHEN length(c) >= 3 AND length(e) >= 3 AND (contains(c, e) OR contains(e, c)) THEN 18 WHEN s >= 0.72 THEN CAST(floor(s * 14 + 0.5) AS INTEGER) ELSE 0 END AS score FROM p""")
def caption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each order's caption fits that of the next order."""
    own = tables.orders(spark, sf_dir).selectExpr("id", "concat(if(id % 2 = 0, '图', '表'), id % 4, ' ', if(id % 3 = 0, '', plan)) AS line")
    captions = own.select("id", rules.caption(F.col("line")).alias("c"))
    # ids are dense, so the next one is found by a join; a window over all rows would run in one task
    after = captions.join(captions.select((F.col("id") - 1).alias("before"), F.col("c").alias("e"), F.col("id").alias("next")), F.col("id") == F.col("before"))
    return after.select("id", blocks.caption_score(F.col("c"), F.col("e")).alias("score"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, string_agg('<div class="table-caption">原始表格 ' || k || '</div><table><tr><td>' || t || '</td><td>' || md5('' || r) || '</td></tr></table>', '' ORDER BY r) AS b, count(*) AS lost FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS k FROM l WHERE r % 2 = 0) GROUP BY 1)
SELECT doc_id, md5(coalesce((SELECT string_agg('<TABLE><td>' || upper(t) || '&nbsp;</td> ' || md5('' || r) || '</TABLE>', '' ORDER BY r DESC) FROM l WHERE l.doc_id = d.doc_id AND r % 2 = 1), '') || CASE WHEN b IS NULL THEN '' ELSE '<p><strong>附录: 未能定位到原位置的表格</strong></p>' || b END) AS hash, coalesce(lost, 0) AS lost FROM documents d LEFT JOIN h USING (doc_id)""")
def missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten document has every other table, in another order and form."""
    source = joined("concat('<table><tr><td>', t, '</td><td>', md5(string({r})), '</td></tr></table>')")
    output = "array_join(reverse(filter(transform(ts, (t, j) -> if(j % 2 = 0, concat('<TABLE><td>', upper(t), '&nbsp;</td> ', md5(string(j + 1)), '</TABLE>'), '')), x -> x != '')), '')"
    pairs = lines(spark, sf_dir).selectExpr("doc_id", f"{source} AS a", f"{output} AS b")
    done = rewriting.with_missing_tables(pairs, "doc_id", "a", "b")
    lost = F.coalesce(F.get(F.transform("issues", lambda i: i["n"]), F.lit(0)), F.lit(0))
    return done.select("doc_id", F.md5(F.col("html").cast("binary")).alias("hash"), lost.alias("lost"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 0 ELSE 2 END AS titles, CASE page_id % 3 WHEN 2 THEN 1 ELSE 0 END AS title_again FROM pages")
def structure_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below a title that is there once, twice, or once more as a heading as well."""
    title = "'<h1 class=\"doc-title\">Title of the page</h1><h2 class=\"doc-title-en\">x</h2>'"
    html = f"concat({title}, if(page_id % 3 > 0, '<h1 class=\"a doc-title\">Other</h1>', ''), if(page_id % 3 = 2, '<h3>2.1 Title <b>of</b> the page</h3>', ''), regexp_replace(html, '<h1', '<h1 id=\"own\"')) AS html"
    return blocks.anomalies(pages(spark, sf_dir).selectExpr("page_id", html), "page_id")


@query(f"""WITH p AS (SELECT page_id, html AS a, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '<h1>[^<]*</h1>', '', 'g') ELSE html END AS b FROM pages), i AS (SELECT page_id, {counts('a')} FROM p), o AS (SELECT page_id, {counts('b')} FROM p)
SELECT page_id, i.headings AS headings_in, o.headings AS headings_out, CASE WHEN i.chars > 0 THEN CAST(floor(100.0 * o.chars / i.chars + 0.5) AS BIGINT) ELSE 100 END AS retention, o.headings >= i.headings AND page_id % 5 <> 1 AS headings_matched, page_id % 5 = 2 AS truncated FROM i JOIN o USING (page_id)""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other page lost its title; some have issues that say that headings are missing, or that a loop was cut."""
    issue = "array(struct(CASE page_id % 5 WHEN 1 THEN 'heading_missing' WHEN 2 THEN 'loop_truncated' ELSE 'image_missing' END AS type, 'warning' AS severity, 1L AS n)) AS issues"
    pairs = pages(spark, sf_dir).selectExpr("page_id", "html AS a", "if(page_id % 2 = 0, regexp_replace(html, '<h1>[^<]*</h1>', ''), html) AS b", issue)
    found = rewriting.report(pairs, "page_id", "a", "b", "issues")
    return found.select("page_id", F.col("input.headings").alias("headings_in"), F.col("output.headings").alias("headings_out"), "retention", "headings_matched", "truncated")


@query()
def loop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as paragraphs, five in six of them ending in a loop: what is found and how much is left."""
    loops = ["", "repeat('the same words come back ', 40)", "array_join(transform(sequence(1, 8), i -> concat('(', i, ') the one body of all items')), ' ')", "repeat('This sentence keeps coming back again and again! ', 12)", "repeat('ab', 200)", "repeat('</p><p>', 30)"]
    end = " ".join(f"WHEN {i} THEN {x or repr('')}" for i, x in enumerate(loops))
    html = joined("concat('<p>', t, '</p>')") + f" || concat('<p>', CASE doc_id % 6 {end} END, '</p>')"
    done = rewriting.without_loops(lines(spark, sf_dir).selectExpr("doc_id", f"{html} AS html"))
    return done.select("doc_id", "loop", F.length("html").alias("chars"), F.sha2("html", 256).alias("html_sha256"))


CHUNK_IN = "html || '<p>__IMG_1__</p><table></table>' || repeat('<li>', CAST(page_id % 9 AS INTEGER))"
CHUNK_OUT = "CASE page_id % 4 WHEN 0 THEN substr(s, 1, CAST(floor(length(s) / 3) AS INTEGER)) WHEN 1 THEN repeat(s, 5) WHEN 2 THEN replace(replace(s, '<table>', ''), '<li>', '') ELSE s END"


@query(f"""WITH p AS (SELECT page_id, s, {CHUNK_OUT} AS o FROM (SELECT page_id, {CHUNK_IN} AS s FROM pages)), q AS (SELECT page_id, s, o, length({compact('s')}) AS a, length({compact('o')}) AS b, greatest({n('s', '(?i)<li\\b')}, {n('s', r'[(（]\s*[0-9]+\s*[)）]')}) AS la, greatest({n('o', '(?i)<li\\b')}, {n('o', r'[(（]\s*[0-9]+\s*[)）]')}) AS lb FROM p)
SELECT page_id, concat_ws(',', CASE WHEN a > 500 AND b < floor(a * 0.45) THEN 'too_short' END, CASE WHEN a > 500 AND b > a * 3.8 THEN 'too_long' END, CASE WHEN page_id % 5 = 0 THEN 'headings' END, CASE WHEN NOT contains(o, '__IMG_1__') THEN 'images' END, CASE WHEN {n('o', '(?i)<table\\b')} < {n('s', '(?i)<table\\b')} THEN 'tables' END, CASE WHEN la >= 5 AND lb < floor(la * 0.6) THEN 'list_items' END) AS issues FROM q""")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut short, five times as long, and without their tables and items; the sign of a loop is left to the tests."""
    rows = pages(spark, sf_dir).selectExpr("page_id", f"{CHUNK_IN.replace('CAST(page_id % 9 AS INTEGER)', 'int(page_id % 9)')} AS s")
    rows = rows.selectExpr("page_id", "s", f"{CHUNK_OUT.replace('CAST(floor(length(s) / 3) AS INTEGER)', 'int(floor(length(s) / 3))')} AS o", "if(page_id % 5 = 0, array('Title never met'), array()) AS h")
    found = rewriting.checked_chunks(rows, "s", "o", "h", ["page_id"])
    return found.select("page_id", F.array_join(F.array_remove("issues", "repetition"), ",").alias("issues"))


PLAIN = "trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
BARE = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?:[0-9]+\\.)+\\s*', '', 'g'), '第[一-龥0-9]+[章节条款部分]\\s*', '', 'g'), '\\s+', ' ', 'g'))"
CHUNK = "'<h2>Part of ' || doc_id || '</h2><p>' || coalesce(text, '') || '</p>'"


@query(f"""WITH c AS (SELECT doc_id, {PLAIN.format(x=CHUNK)} AS p FROM documents), b AS (SELECT doc_id, p, {BARE.format(x='p')} AS u FROM c),
o AS (SELECT doc_id, p, coalesce(list_max(list_filter(range(80, least(length(u), 2600) + 1), lambda k: right(u, k) = left(u, k))), 0) AS overlap FROM b)
SELECT doc_id, CAST(overlap AS INTEGER) AS overlap, overlap >= 320 AND overlap / least(length(p), 2600) >= 0.78 AND contains(right(p, 5000), 'Part of ' || doc_id) AS skipped FROM o""")
def chunk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text comes as two chunks that are the same: the second is skipped where the first one's end covers it."""
    content = "concat('<h2>Part of ', doc_id, '</h2><p>', coalesce(text, ''), '</p>') AS content"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", content, "explode(array(0, 1)) AS chunk_no")
    return rewriting.uncovered_chunks(d.withColumn("output", F.col("content"))).where("chunk_no = 1").select("doc_id", "overlap", "skipped")


OFFICIAL = ["'<p>机密</p>'", "'<div>' || segment || '文件</div>'", "'<p>政发〔2026〕' || id || '号</p>'", "'<h1>关于' || id || '的通知</h1>'", "'<p>' || segment || '：</p>'", "'<p>Text ' || id || '.</p>'"]
MARKED = ["'<p class=\"doc-classification\">机密</p>'", "'<div class=\"doc-issuer\">' || segment || '文件</div>'", "'<p class=\"doc-ref-number\">政发〔2026〕' || id || '号</p>'", "'<h1 class=\"doc-title\">关于' || id || '的通知</h1>'", "'<p class=\"doc-addressee\">' || segment || '：</p>'", "'<p>Text ' || id || '.</p>'"]


def turned(parts: list[str]) -> str:
    """SQL: the parts in one of three orders; every fifth document has no title."""
    titled = [f"CASE WHEN id % 5 = 0 THEN '' ELSE {p} END" if i == 3 else p for i, p in enumerate(parts)]
    orders = [[5, 4, 3, 2, 1, 0], [3, 5, 0, 4, 2, 1], [0, 1, 2, 3, 4, 5]]
    return "CASE id % 3 " + " ".join(f"WHEN {k} THEN {' || '.join(titled[i] for i in o)}" for k, o in enumerate(orders)) + " END"


USERS_OF = "(SELECT c_custkey AS id, c_mktsegment AS segment FROM customer)"


@query(f"""SELECT id, CASE WHEN id % 5 = 0 THEN {turned(MARKED)} ELSE {MARKED[0]} || chr(10) || {MARKED[1]} || chr(10) || '<hr class="doc-divider">' || chr(10) || {MARKED[2]} || chr(10) || {MARKED[3]} || chr(10) || {MARKED[4]} || chr(10) || {MARKED[5]} END AS html FROM {USERS_OF}""")
def official_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of official documents in three orders, unmarked."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_mktsegment AS segment")
    return rewriting.official(c.selectExpr("id", f"{turned(OFFICIAL)} AS html"))


FULL = "k.top - f.start >= f.h AND f.held > 0"


@query(f"""WITH RECURSIVE b AS (SELECT user_id AS doc_id, id AS pos, (sum(id % 97) OVER w - id % 97) * 11 AS top, id % 29 = 0 AS cover, id % 13 = 0 AS split, row_number() OVER w AS r FROM {ORDERS} WINDOW w AS (PARTITION BY user_id ORDER BY id)),
k AS (SELECT b.*, lead(top) OVER (PARTITION BY doc_id ORDER BY r) AS next_top FROM b),
f AS (SELECT doc_id, pos, r, 1 AS sheet, CASE WHEN cover THEN 2 ELSE 1 END AS open, CASE WHEN cover THEN 0 ELSE 1 END AS held, CASE WHEN cover THEN coalesce(next_top, top) ELSE top END AS start, CASE WHEN split AND NOT cover THEN 2000 ELSE 1000 END AS h FROM k WHERE r = 1
UNION ALL SELECT k.doc_id, k.pos, k.r, CASE WHEN k.cover THEN f.open + CAST(f.held > 0 AS INTEGER) WHEN {FULL} THEN f.open + 1 ELSE f.open END, CASE WHEN k.cover THEN f.open + CAST(f.held > 0 AS INTEGER) + 1 WHEN {FULL} THEN f.open + 1 ELSE f.open END,
CASE WHEN k.cover THEN 0 WHEN {FULL} THEN 1 ELSE f.held + 1 END, CASE WHEN k.cover THEN coalesce(k.next_top, k.top) WHEN {FULL} THEN k.top ELSE f.start END, CASE WHEN k.split AND NOT k.cover THEN 2000 ELSE f.h END FROM f JOIN k ON k.doc_id = f.doc_id AND k.r = f.r + 1)
SELECT doc_id, pos, sheet, max(sheet) OVER (PARTITION BY doc_id) AS sheets FROM f""")
def page_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's orders as blocks of a height, some of them covers: pages of 1,000, twice as much behind what splits into two columns."""
    top = "(sum(id % 97) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) - id % 97) * 11 AS top"
    rows = tables.orders(spark, sf_dir).selectExpr("user_id AS doc_id", "id AS pos", top, "id % 29 = 0 AS cover", "id % 13 = 0 AS split")
    return rewriting.sheets(rows, 1000, 2)


@query("""SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN '__IMG_0__<div class="figure-caption">Figure 9</div>' || repeat('x', 700) || '__IMG_1__' || chr(10) || '<div class="figure-caption">Figure ' || (page_id % 4 + 2) || '</div>' ELSE '__IMG_0__' || chr(10) || '<div class="figure-caption">Figure ' || (page_id % 4 + 1) || '</div>' END || html) AS hash FROM pages""")
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a caption below them get one, numbered on."""
    html = "concat(if(page_id % 2 = 0, concat('__IMG_0__<div class=\"figure-caption\">Figure 9</div>', repeat('x', 700), '__IMG_1__'), '__IMG_0__'), html) AS html"
    done = pages(spark, sf_dir).selectExpr("page_id", html).withColumn("html", rewriting.with_figure_captions(F.col("html"), F.col("page_id") % 4))
    return done.select("page_id", F.md5(F.col("html").cast("binary")).alias("hash"))


@query("""SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN '__IMG_0__' || chr(10) || '<div class="figure-caption">a</div>' || html || '__IMG_1__<div class="figure-caption">b</div>' || chr(10) || '<p>__IMG_2__</p>' ELSE html || '__IMG_0____IMG_1____IMG_2__' END) AS hash FROM pages""")
def placeholders_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that every other page lost stand again before a caption that has none, or at the end."""
    output = "if(page_id % 2 = 0, concat('<div class=\"figure-caption\">a</div>', html, '__IMG_1__<div class=\"figure-caption\">b</div>'), concat(html, '__IMG_0____IMG_1____IMG_2__')) AS b"
    rows = pages(spark, sf_dir).selectExpr("page_id", "'__IMG_0__ __IMG_1__ __IMG_2__' AS a", output)
    return rows.select("page_id", F.md5(rewriting.with_placeholders(rows, "a", "b").cast("binary")).alias("hash"))

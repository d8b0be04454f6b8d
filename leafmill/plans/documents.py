"""Queries over documents, pages and conversations, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import documents, quality, structure
from leafmill.sources import tables
from leafmill.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S = tx.SPACE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '{S}+', ' ', 'g'))"


def plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in tx.ENTITIES.items():
        quoted = b.replace("'", "''")
        out = f"replace({out}, '{a}', '{quoted}')"
    return f"trim(regexp_replace({out}, '{S}+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '{S}+', '', 'g')"


def n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def counts(x: str) -> str:
    return rf"{n(x, r'(?i)<p\b')} AS paragraphs, {n(x, r'(?i)<h[1-6]\b[^>]*>')} - {n(x, r'(?i)<h[1-6]\b[^>]*doc-title[^>]*>')} AS headings, greatest({n(x, r'(?i)<li\b')}, {n(x, r'[(（]\s*[0-9]+\s*[)）]')}) AS items, {n(x, r'(?i)<img\b')} + {n(x, '__IMG_[0-9]+__')} AS images, {n(x, r'(?i)<table\b')} AS tables, length({compact(x)}) AS chars"


@query(f"SELECT page_id, {counts('html')} FROM pages")
def html_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", *structure.counts(F.col("html")))


@query(f"SELECT page_id, {plain('html')} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", tx.plain(F.col("html")).alias("text"))


HEADINGS = f"(SELECT page_id, pos, CAST(level AS INTEGER) AS level, {plain('title')} AS title FROM (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS level, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '{structure.HEADING}', 1) AS l, regexp_extract_all(html, '{structure.HEADING}', 2) AS t FROM pages)))"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, level, title FROM {HEADINGS}")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.headings(pages(spark, sf_dir), "page_id")


@query(f"SELECT level, count(*) AS n, count(DISTINCT page_id) AS pages FROM {HEADINGS} GROUP BY level")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.headings(pages(spark, sf_dir), "page_id").groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


AUDITED = squeezed("regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g')")


@query(f"SELECT page_id, length(html) AS chars, length({AUDITED}) AS text_chars, {n('html', '(?i)<ol[ >]')} AS lists, {n('html', '(?i)<br')} AS breaks FROM pages")
def html_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_of = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return pages(spark, sf_dir).select("page_id", F.length("html").cast("long").alias("chars"), F.length(tx.audited(F.col("html"))).cast("long").alias("text_chars"), n_of("(?i)<ol[ >]").alias("lists"), n_of("(?i)<br").alias("breaks"))


# the lines of documents stand in for headings: their level follows from their length
LINES = "(SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, 1 + length(line) % 3 AS level, CASE length(line) % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> '')"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("line")
    return structure.lines(docs(spark, sf_dir)).withColumns({"level": 1 + size % 3, "kind": F.when(size % 4 == 0, "figure").when(size % 4 == 1, "table")})


COUNTED = f"(SELECT *, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, c1, c2 ORDER BY pos) AS c3 FROM (SELECT *, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, c1 ORDER BY pos) AS c2 FROM (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY pos) AS c1 FROM {LINES})))"


@query(f"SELECT doc_id, pos, CAST(level AS INTEGER) AS level, CASE WHEN level = 1 THEN c1 || '.' WHEN c1 = 0 THEN '' WHEN level = 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END AS number FROM {COUNTED}")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_numbers(heads(spark, sf_dir))


@query()
def heading_numbers_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_numbers(heads(spark, sf_dir), "chinese-hierarchical")


@query()
def heading_numbers_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_numbers(heads(spark, sf_dir), "chapter")


@query(f"SELECT doc_id, pos, concat_ws(' > ', last_value(CASE WHEN level = 1 THEN substr(line, 1, 140) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), last_value(CASE WHEN level = 2 THEN substr(line, 1, 140) END IGNORE NULLS) OVER (PARTITION BY doc_id, c1 ORDER BY pos), last_value(CASE WHEN level = 3 THEN substr(line, 1, 140) END IGNORE NULLS) OVER (PARTITION BY doc_id, c1, c2 ORDER BY pos)) AS path FROM {COUNTED}")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_paths(heads(spark, sf_dir))


CAPTIONS = f"(SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM {LINES})"


@query(f"SELECT doc_id, pos, kind, CASE WHEN chapter > 0 THEN chapter || '-' ELSE '' END || row_number() OVER (PARTITION BY doc_id, kind, chapter ORDER BY pos) AS number FROM {CAPTIONS} WHERE kind IS NOT NULL")
def chapter_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.caption_numbers(heads(spark, sf_dir), True)


@query(f"SELECT doc_id, pos, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS VARCHAR) AS number FROM {LINES} WHERE kind IS NOT NULL")
def captions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.caption_numbers(heads(spark, sf_dir), False)


@query(f"SELECT doc_id, pos, CAST(level - min(level) OVER (PARTITION BY doc_id) + 1 AS INTEGER) AS level FROM (SELECT doc_id, pos, level + 1 AS level FROM {LINES})")
def level_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.shifted(heads(spark, sf_dir).withColumn("level", F.col("level") + 1))


@query(f"SELECT doc_id, pos FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {LINES}) WHERE line = b AND length(line) >= 30")
def dup_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repeated_neighbours(heads(spark, sf_dir))


NUMBERS = f"(SELECT *, CASE WHEN length(line) % 2 = 0 THEN length(line) END AS n FROM {LINES})"


@query(f"SELECT doc_id, pos, n, b AS before FROM (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {NUMBERS}) WHERE n <= b")
def number_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heads(spark, sf_dir).withColumn("n", F.when(F.length("line") % 2 == 0, F.length("line").cast("long")))
    return structure.number_regressions(rows)


@query(f"SELECT doc_id, min(pos) AS first, count(*) AS length FROM (SELECT *, r - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM {LINES}) WHERE level = 1) GROUP BY doc_id, island HAVING count(*) >= 2")
def level_one_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.runs(heads(spark, sf_dir), F.col("level") == 1)


@query("SELECT doc_id, p AS size, instr(substr(text, p + 1), substr(text, 1, p)) > 0 AS repeated FROM documents, (VALUES (60), (120), (600)) v(p) WHERE length(text) > p")
def repeat_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = docs(spark, sf_dir).select("doc_id", "text", F.explode(F.array(F.lit(60), F.lit(120), F.lit(600))).alias("size")).where(F.length("text") > F.col("size"))
    again = F.instr(F.substring("text", F.col("size") + 1, F.length("text")), F.substring("text", F.lit(1), F.col("size"))) > 0
    return sizes.select("doc_id", "size", again.alias("repeated"))


SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '(?i)</(?:p|div|li|h[1-6]|tr)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[。！？!?;；\\n]'), lambda s: regexp_replace(regexp_replace(s, '" + quality.BULLET + "', ''), '" + S + "+', '', 'g')), lambda s: length(s) >= 8)"
PAIRS = "(SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")


@query(f"WITH r AS (SELECT doc_id, {SENTENCES.replace('{x}', 'a')} AS a, {SENTENCES.replace('{x}', 'b')} AS b, {compact('a')} AS ca, {compact('b')} AS cb FROM {PAIRS}), d AS (SELECT doc_id, len(a) AS n, list_filter(a, lambda s: NOT contains(cb, s)) AS g, list_filter(b, lambda s: NOT contains(ca, s)) AS w FROM r) SELECT doc_id, least(60, len(list_distinct(g))) AS removed, least(60, len(list_distinct(w))) AS added, len(g) AS n_removed, CASE WHEN n > 0 THEN CAST(round(100.0 * (n - len(g)) / n) AS BIGINT) ELSE 100 END AS retention FROM d")
def content_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.content_diff(neighbours(spark, sf_dir), "doc_id", "a", "b")


@query(f"SELECT doc_id, len(list_intersect(a, b)) AS common, CASE WHEN least(len(list_distinct(a)), len(list_distinct(b))) > 0 THEN round(len(list_intersect(a, b)) / least(len(list_distinct(a)), len(list_distinct(b))), 4) ELSE 0 END AS coverage FROM (SELECT doc_id, string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM {PAIRS})")
def fingerprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(spark, sf_dir).select("doc_id", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return quality.shared(rows, "doc_id", "a", "b")


THIN = "(?is)<(?:p|li)>[^<]*</(?:p|li)>"


def rule(name: str, bad: str, critical: str) -> str:
    return f"CASE WHEN {bad} THEN '{name}:' || CASE WHEN {critical} THEN 'critical' ELSE 'warning' END END"


RULES = ", ".join([rule("images", "o.images < i.images", "true"), rule("tables", "o.tables < i.tables", "o.tables = 0 OR i.tables - o.tables >= 0.3 * i.tables"), rule("items", "i.items >= 5 AND o.items < floor(i.items * 0.7)", "o.items < floor(i.items * 0.4)"), rule("paragraphs", "i.paragraphs >= 10 AND o.paragraphs < floor(i.paragraphs * 0.35) AND o.chars < 0.9 * i.chars", "o.chars < 0.75 * i.chars"), rule("content", "i.chars >= 1000 AND o.chars < floor(i.chars * 0.85)", "o.chars < floor(i.chars * 0.7)"), rule("expansion", "i.chars >= 1000 AND o.chars > 3 * i.chars", "o.chars > 4 * i.chars")])


@query(f"WITH p AS (SELECT page_id, html AS a, regexp_replace(html, '{THIN}', '', 'g') AS b FROM pages), i AS (SELECT page_id, {counts('a')} FROM p), o AS (SELECT page_id, {counts('b')} FROM p), r AS (SELECT page_id, concat_ws(',', {RULES}) AS issues, CASE WHEN i.chars > 0 THEN CAST(round(100.0 * o.chars / i.chars) AS BIGINT) ELSE 100 END AS retention FROM i JOIN o USING (page_id)) SELECT page_id, issues, retention, contains(issues, ':critical') OR retention < 85 AS low_quality FROM r")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pages(spark, sf_dir).select("page_id", F.col("html").alias("a"), F.regexp_replace("html", THIN, "").alias("b"))
    return quality.integrity(pairs, "page_id", "a", "b")


@query()
def loop_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(docs(spark, sf_dir))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunks(docs(spark, sf_dir), 2000).select("doc_id", "chunk_no", "start", "end", "strategy")


@query()
def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.packed(pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), 2000)


@query()
def chunk_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(spark, sf_dir).select("doc_id", F.array(tx.squeezed(F.col("a")), tx.squeezed(F.col("b"))).alias("chunks"))
    return documents.compressed(rows)


@query()
def repair_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.repaired(pages(spark, sf_dir)).select("page_id", F.sha2("html", 256).alias("html_sha256"))


@query()
def image_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<p>__IMG_1__</p><img src='x'><p>__IMG_1__ __IMG_9__</p>"), F.col("html"))
    rows = pages(spark, sf_dir).select("page_id", html.alias("html"), F.array(F.lit("__IMG_1__"), F.lit("__IMG_2__")).alias("expected"))
    return quality.images(rows, "page_id", "html", "expected").select("page_id", "missing", "duplicated", F.sha2("html", 256).alias("html_sha256"))


@query()
def skeleton_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda c: F.transform(F.split(c, "\n"), lambda x: tx.heading_key(x))
    return documents.aligned(neighbours(spark, sf_dir).select("doc_id", keys("a").alias("outline"), F.reverse(keys("a")).alias("found")))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(text, '' ORDER BY turn) AS content FROM (SELECT c.*, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS b FROM conversations c) WHERE b IS NULL OR turn >= b GROUP BY conv_id")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = F.col("role") == "system"
    return folds.folded(c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.when(~whole, F.col("text")).alias("delta"), F.when(whole, F.col("text")).alias("text"), F.lit(False).alias("done")))


WALK = "WITH RECURSIVE e AS (SELECT event_id AS id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w AS (SELECT id, user_id, ts, r, ts AS start, CAST(1 AS BIGINT) AS n FROM e WHERE r = 1 UNION ALL SELECT e.id, e.user_id, e.ts, e.r, CASE WHEN e.ts >= w.start + INTERVAL {s} SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL {s} SECOND THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) "


@query(WALK.format(s=432000) + "SELECT id, user_id, n, n <= 10 AS accepted FROM w")
def rate_limit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.limited(tables.usage_log(spark, sf_dir), "user_id", 432_000, 10)


@query(WALK.format(s=86400) + "SELECT id, user_id FROM w WHERE n = 1")
def replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.once(tables.usage_log(spark, sf_dir), "user_id")


@query(WALK.format(s=60) + "SELECT id, user_id FROM w WHERE n = 1")
def throttle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.once(tables.usage_log(spark, sf_dir), "user_id", 60)


@query("SELECT c_custkey AS id, substr(p, 1, 3) || '****' || right(p, 4) AS masked, regexp_matches(p, '^1[3-9][0-9]{9}$') AS valid FROM (SELECT c_custkey, '1' || CAST(3000000000 + c_custkey * 7919777 AS VARCHAR) AS p FROM customer)")
def mask_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    phone = F.concat(F.lit("1"), (F.lit(3_000_000_000) + F.col("c_custkey") * 7_919_777).cast("string"))
    return c.select(F.col("c_custkey").alias("id"), tx.masked_phone(phone).alias("masked"), tx.is_mobile(phone).alias("valid"))


@query("SELECT c_custkey AS id, CASE replace(lower(trim(m)), '_', '-') WHEN 'building' THEN 'corporate' WHEN 'work-report' THEN 'work-report' ELSE 'academic' END AS preset FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' Work_Report ' ELSE c_mktsegment END AS m FROM customer)")
def preset_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % 3 == 0, " Work_Report ").otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), tx.preset(name, {"building": "corporate"}).alias("preset"))


@query("SELECT event_id AS id, CASE WHEN contains(event_type, 'err') THEN 'FAILED' WHEN contains(event_type, 'i') THEN 'SEEN' ELSE 'OTHER' END AS code FROM events")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usage_log(spark, sf_dir).select("id", tx.classified(F.col("action"), {"FAILED": ["err"], "SEEN": ["i"]}, "OTHER").alias("code"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.0) + ceil(n_chars / 6.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", tx.token_estimate(F.length("text"), F.col("n_chars") / 2).alias("tokens"))

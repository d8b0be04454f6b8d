"""Queries over the rules of requests, estimates and notices, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import rules, text as tx
from leafmill.plans.operations import ORDERS, USAGE, USERS
from leafmill.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Messages of which each reaches one branch of the error rule, and one none.
MESSAGES = [needles[-1] for needles in rules.ERRORS.values()] + ["something else", "invalid_api_key and ETIMEDOUT"]
PLANS = [*rules.PRICES, "unknown"]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def dealt(values: list[str], by: str) -> str:
    """SQL: the value whose number is the remainder."""
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({by} % {len(values)} AS INTEGER) + 1]"


def picked(values: list[str], by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


CASES = " ".join("WHEN " + " OR ".join(f"contains(m, '{x}')" for x in needles) + f" THEN '{code}'" for code, needles in rules.ERRORS.items())


@query(f"SELECT id, CASE {CASES} ELSE '{rules.OTHER_ERROR}' END AS code FROM (SELECT id, {dealt(MESSAGES, 'id')} AS m FROM {USAGE})")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.usage_log(spark, sf_dir).select("id", picked(MESSAGES, "id").alias("m"))
    return log.select("id", tx.classified(F.col("m"), rules.ERRORS, rules.OTHER_ERROR).alias("code"))


@query(f"""WITH l AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')[1], '') AS f FROM documents),
s AS (SELECT doc_id, f, {trimmed("string_split_regex(f, '[。.!?！？]')[1]")} AS s FROM l), b AS (SELECT doc_id, f, {trimmed("regexp_replace(substr(CASE WHEN s <> '' THEN s ELSE f END, 1, 30), '[\\\\/:*?\"<>|]', '', 'g')")} AS b FROM s)
SELECT doc_id, CASE WHEN f = '' THEN 'document' WHEN b <> '' THEN b ELSE 'pasted' END || '.txt' AS name FROM b""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rules.file_name(F.col("text")).alias("name"))


@query(f"SELECT id, id IN (3, 5, 11) AS is_admin FROM {USERS}")
def admin_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.users(spark, sf_dir).select("id", rules.is_member(F.col("id").cast("string"), F.lit(" 3, 5,, 11 ,")).alias("is_admin"))


@query("""SELECT doc_id, text IS NULL OR text = '' AS missing, CASE WHEN raw > 60000000 THEN 'too_large' WHEN chars > CASE doc_id % 4 WHEN 0 THEN 200000 WHEN 1 THEN 2000000 WHEN 2 THEN 2000000 ELSE 200000 END THEN 'too_long' END AS fault
FROM (SELECT doc_id, text, coalesce(length(text), 0) * 20000 AS raw, coalesce(length(text), 0) * 400 AS chars FROM documents)""")
def payload_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as long as 400 copies of a text, and 20,000 with their images, against the limits of tiers (one unknown)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    fault = rules.payload(F.col("n") * 20_000, F.col("n") * 400, picked(["FREE", "PLUS", "ULTRA", "other"], "doc_id"))
    return d.select("doc_id", rules.missing(F.col("text")).alias("missing"), fault.alias("fault"))


@query(f"SELECT id, CASE id % 3 WHEN 0 THEN 'PARTIAL_GENERATING' WHEN 1 THEN 'PART_COMPLETE' END AS kind, CASE WHEN id % 3 < 2 THEN CAST(id % 7 AS INTEGER) END AS part, CASE WHEN id % 3 < 2 THEN 9 END AS parts FROM {USAGE}")
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(picked(["PARTIAL_GENERATING|", "PART_COMPLETE|", "DONE "], "id"), (F.col("id") % 7).cast("string"), F.lit("|9"))
    found = tables.usage_log(spark, sf_dir).select("id", rules.progress(line).alias("p"))
    return found.select("id", "p.kind", "p.part", "p.parts")


@query(f"SELECT id, CASE WHEN id % 11 = 0 OR r < 90 OR s <> 'info' THEN CASE WHEN s = 'critical' THEN 'critical' ELSE 'warning' END END AS level, CASE WHEN id % 11 = 0 THEN 'truncated' WHEN r < 90 THEN 'retention' WHEN s <> 'info' THEN 'issues' END AS reason FROM (SELECT id, 80 + id % 21 AS r, {dealt(['info', 'warning', 'info', 'critical'], 'id')} AS s FROM {USAGE})")
def report_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    severities = F.array(F.lit("info"), picked(["info", "warning", "info", "critical"], "id"))
    found = tables.usage_log(spark, sf_dir).select("id", rules.notice(F.col("id") % 11 == 0, 80 + F.col("id") % 21, severities).alias("n"))
    return found.select("id", "n.level", "n.reason")


@query(f"SELECT u.id, CASE WHEN n > 1000 THEN printf('%.1f', n / 1000) || 'k' ELSE CAST(coalesce(n, 0) AS VARCHAR) END AS shown FROM {USERS} u LEFT JOIN (SELECT user_id, count(*) * 50 + 1 AS n FROM {USAGE} GROUP BY 1) e ON e.user_id = u.id")
def compact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = tables.usage_log(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg((F.count("*") * 50 + 1).alias("n"))
    return tables.users(spark, sf_dir).select("id").join(totals, "id", "left").select("id", rules.compact_number(F.col("n")).alias("shown"))


MODELS = [*rules.CHUNKS, "other"]


@query(f"SELECT doc_id, CAST(size AS BIGINT) AS chunk_size, CAST(ceil(n / size) AS BIGINT) AS n_chunks, CAST(ceil(n / size) AS BIGINT) * 15 AS seconds_left, CAST(ceil(n / 10000 * 15) AS BIGINT) + 5 AS seconds, CAST(greatest(15, floor(n / 1000 * 20 + 0.5)) AS BIGINT) AS rough_seconds FROM (SELECT doc_id, CAST(coalesce(length(text), 0) AS DOUBLE) AS n, greatest(4000, floor(CASE doc_id % 5 WHEN 1 THEN 16000 WHEN 2 THEN 9000 WHEN 3 THEN 6000 ELSE 12000 END * CASE WHEN doc_id % 2 = 0 THEN 1.35 ELSE 1 END)) AS size FROM documents)")
def generation_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("n"), rules.chunk_size(picked(MODELS, "doc_id"), picked(["ULTRA", "PRO"], "doc_id")).alias("chunk_size"))
    chunks = F.ceil(F.col("n") / F.col("chunk_size"))
    return d.select("doc_id", "chunk_size", chunks.alias("n_chunks"), (chunks * 15).alias("seconds_left"), (F.ceil(F.col("n") / 10000 * 15) + 5).alias("seconds"), F.greatest(F.lit(15), F.floor(F.col("n") / 1000 * 20 + 0.5)).alias("rough_seconds"))


@query("SELECT page_id, CASE WHEN k >= length(html) THEN length(html) WHEN o > c THEN o ELSE k END AS cut FROM (SELECT *, CASE WHEN instr(f, '<') = 0 THEN -1 ELSE k - instr(f, '<') END AS o, CASE WHEN instr(f, '>') = 0 THEN -1 ELSE k - instr(f, '>') END AS c FROM (SELECT page_id, html, CAST(50 + page_id % 400 AS INTEGER) AS k, reverse(substr(html, 1, CAST(50 + page_id % 400 AS INTEGER))) AS f FROM pages))")
def html_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", rules.safe_slice(F.col("html"), (50 + F.col("page_id") % 400).cast("int")).alias("cut"))


@query(f"SELECT id, upper(md5('id=' || id || CASE WHEN id % 3 = 0 THEN '' ELSE '&note=n' || user_id END || '&status=' || status || '&key=k')) AS sign FROM {ORDERS} WHERE status IS NOT NULL")
def signed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("user_id").cast("string")))
    params = F.create_map(F.lit("status"), F.col("status"), F.lit("sign"), F.lit("old"), F.lit("note"), note, F.lit("id"), F.col("id").cast("string"))
    return tables.orders(spark, sf_dir).where("status is not null").select("id", rules.signed(params, "k").alias("sign"))


@query(f"SELECT id, substr('RF_' || right(regexp_replace('ORD/' || id || '-' || user_id || ' x', '[^A-Za-z0-9_-]', '', 'g'), 32) || '_' || lower(to_base(1700000000000 + id, 36)), 1, 64) AS number FROM {ORDERS}")
def refund_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.concat(F.lit("ORD/"), F.col("id").cast("string"), F.lit("-"), F.col("user_id").cast("string"), F.lit(" x"))
    return tables.orders(spark, sf_dir).select("id", rules.refund_number(order, F.lit(1_700_000_000_000) + F.col("id")).alias("number"))


PRICED = "(VALUES " + ", ".join(f"('{k}', {cents}, {days})" for k, (cents, days) in rules.PRICES.items()) + ") v(plan, cents, days)"


@query(f"SELECT id, o.plan, cents, days FROM (SELECT id, {dealt(PLANS, 'id')} AS plan FROM {ORDERS}) o LEFT JOIN {PRICED} ON v.plan = o.plan")
def plan_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([(k, *v) for k, v in rules.PRICES.items()], "plan string, cents int, days int")  # six rows
    return tables.orders(spark, sf_dir).select("id", picked(PLANS, "id").alias("plan")).join(F.broadcast(prices), "plan", "left").select("id", "plan", "cents", "days")


@query(f"SELECT id, CASE WHEN c THEN 'FREE' ELSE tier END AS tier, CASE WHEN NOT c THEN end_day END AS end_day, CASE WHEN c THEN tier || '|until_' || coalesce(CAST(end_day AS VARCHAR), 'unknown') END AS audit FROM (SELECT id, tier, tier <> 'FREE' AND id % 3 = 0 AS c, CASE WHEN id % 2 = 0 THEN CAST(DATE '2024-01-01' + CAST(id % 60 AS INTEGER) AS DATE) END AS end_day FROM {USERS})")
def cancelled_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after some have cancelled: free, without an end, and what the audit row of each says."""
    end = F.when(F.col("id") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    users = tables.users(spark, sf_dir).select("id", "tier", end.alias("end_day"), ((F.col("tier") != "FREE") & (F.col("id") % 3 == 0)).alias("c"))
    audit = F.concat(F.col("tier"), F.lit("|until_"), F.coalesce(F.col("end_day").cast("string"), F.lit("unknown")))
    return users.select("id", F.when(F.col("c"), "FREE").otherwise(F.col("tier")).alias("tier"), F.when(~F.col("c"), F.col("end_day")).alias("end_day"), F.when(F.col("c"), audit).alias("audit"))


@query(f"SELECT u.id, CAST(u.id % 5 + CASE WHEN e.user_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS token_version FROM {USERS} u LEFT JOIN (SELECT DISTINCT user_id FROM {USAGE} WHERE id % 4 = 0) e ON e.user_id = u.id")
def token_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter goes up by one for the users that did something."""
    acted = tables.usage_log(spark, sf_dir).where("id % 4 = 0").select(F.col("user_id").alias("id"), F.lit(1).alias("one")).distinct()
    return tables.users(spark, sf_dir).join(acted, "id", "left").select("id", (F.col("id") % 5 + F.coalesce("one", F.lit(0))).cast("long").alias("token_version"))


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM {ORDERS} UNION ALL SELECT id + 100000000, coalesce(status, '') FROM {ORDERS}")
def pending_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders are added as pending, and expire at once where the gateway failed."""
    orders = tables.orders(spark, sf_dir)
    new = orders.select("id", F.when(F.col("id") % 4 == 0, "EXPIRED").otherwise("PENDING").alias("status"))
    return new.union(orders.select(F.col("id") + 100_000_000, F.coalesce("status", F.lit(""))))


@query(f"SELECT id, CASE WHEN user_id % 10 <> 3 AND user_id NOT IN (5, 0) THEN 'forbidden' WHEN status IS DISTINCT FROM 'PAID' THEN 'refused' ELSE 'allowed' END AS verdict FROM {ORDERS}")
def refund_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the asking user (the order's own for some, an administrator for one) may have an order refunded."""
    o = tables.orders(spark, sf_dir)
    owner = F.col("user_id") % 10 == 3
    admin = rules.is_member(F.col("user_id").cast("string"), F.lit("5, 0"))
    return o.select("id", F.when(~(owner | admin), "forbidden").when(~F.col("status").eqNullSafe("PAID"), "refused").otherwise("allowed").alias("verdict"))


@query("SELECT event_id AS id, '[REDACTED]' AS token, '[REDACTED]' AS password, event_type AS action FROM events")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.usage_log(spark, sf_dir).select("id", F.col("preset").alias("token"), F.col("action").alias("password"), "action")
    return log.withColumns({c: F.lit("[REDACTED]") for c in log.columns if c in rules.SECRET_FIELDS})


@query("SELECT page_id, CASE WHEN page_id % 5 <> 0 AND a > 0 AND a > b THEN CASE WHEN (a - b) / a >= 0.3 THEN 'early_stop' ELSE 'headings_reduced' END END AS issue FROM (SELECT page_id, CAST(page_id % 20 AS DOUBLE) AS a, greatest(page_id % 20 - page_id % 9, 0) AS b FROM pages)")
def headings_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (F.col("page_id") % 20).alias("a"), F.greatest(F.col("page_id") % 20 - F.col("page_id") % 9, F.lit(0)).alias("b"))
    return p.select("page_id", rules.headings_lost(F.col("a"), F.col("b"), F.col("page_id") % 5 == 0).alias("issue"))


@query("SELECT doc_id, CAST(floor(length(text) * 3 / 4) AS BIGINT) AS bytes FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)")
def data_url_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", rules.data_url_bytes(url).cast("long").alias("bytes"))


@query(f"SELECT round(sum(tokens), 2) AS tokens, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(ts AS DATE) AS day, sum(tokens) AS tokens, count(*) AS n FROM {USAGE} GROUP BY 1 HAVING CAST(ts AS DATE) >= DATE '2024-01-10')")
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.usage_log(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return daily.where("day >= date '2024-01-10'").agg(F.round(F.sum("tokens"), 2).alias("tokens"), F.sum("n").alias("n"))

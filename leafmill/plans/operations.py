"""Queries over usage, orders and users, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import billing, reports
from leafmill.sources import tables

TODAY, NOW = "2024-01-30", "2001-08-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# the supplied tables as the library's entities
USAGE = "(SELECT event_id AS id, user_id, event_type AS action, props->>'$.k' AS preset, value AS tokens, ts FROM events)"
ORDERS = "(SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderpriority AS plan, CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'REFUNDED' END AS status, o_orderdate AS ts FROM orders)"
USERS = "(SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'PLUS' WHEN 'FURNITURE' THEN 'PRO' WHEN 'HOUSEHOLD' THEN 'ULTRA' ELSE 'FREE' END AS tier, c_acctbal AS balance FROM customer)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add



@query(f"SELECT count(*) FILTER (CAST(ts AS DATE) = DATE '{TODAY}') AS today_count, round(coalesce(sum(tokens) FILTER (CAST(ts AS DATE) = DATE '{TODAY}'), 0), 2) AS today_tokens, count(*) AS total_count, round(coalesce(sum(tokens), 0), 2) AS total_tokens FROM {USAGE}")
def usage_today_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.day_totals(tables.usage_log(spark, sf_dir), TODAY)


@query(f"WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(tokens) AS t, count(*) AS n FROM {USAGE} WHERE action LIKE 'c%' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, month(s.day) || '/' || day(s.day) AS label, round(coalesce(t, 0), 2) AS tokens, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (day)")
def usage_daily_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.usage_log(spark, sf_dir).where(F.col("action").startswith("c"))
    return reports.daily_filled(log, "2024-01-01", TODAY, tokens=F.round(F.sum("tokens"), 2), n=F.count("*"))


@query(f"SELECT preset, count(*) AS n, round(sum(tokens), 2) AS tokens FROM {USAGE} GROUP BY preset")
def usage_by_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_key(tables.usage_log(spark, sf_dir), "preset", n=F.count("*"), tokens=F.round(F.sum("tokens"), 2))


@query(f"SELECT count(DISTINCT user_id) AS active_users FROM {USAGE} WHERE CAST(ts AS DATE) = DATE '{TODAY}'")
def usage_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usage_log(spark, sf_dir).where((F.col("ts") >= F.lit(TODAY).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(TODAY).cast("date"), 1).cast("timestamp_ntz"))).agg(F.countDistinct("user_id").alias("active_users"))


@query(f"SELECT e.id, e.user_id, u.name, u.tier, e.action, e.ts FROM (SELECT * FROM {USAGE} ORDER BY ts DESC, id LIMIT 50) e JOIN {USERS} u ON e.user_id = u.id")
def usage_recent_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = reports.newest(tables.usage_log(spark, sf_dir), 50, "id", "user_id", "action", "ts")
    users = tables.users(spark, sf_dir).select(F.col("id").alias("user_id"), "name", "tier")
    return top.join(users, "user_id").select("id", "user_id", "name", "tier", "action", "ts")


@query(f"SELECT coalesce(sum(amount) FILTER (status = 'PAID' AND CAST(ts AS DATE) = DATE '1998-01-05'), 0)::DECIMAL(22,2) AS today, coalesce(sum(amount) FILTER (status = 'PAID' AND ts >= TIMESTAMP '1998-01-01'), 0)::DECIMAL(22,2) AS period, coalesce(sum(amount) FILTER (status = 'PAID'), 0)::DECIMAL(22,2) AS total, coalesce(sum(amount) FILTER (status = 'REFUNDED'), 0)::DECIMAL(22,2) AS refunded FROM {ORDERS}")
def revenue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid, none = F.col("status") == "PAID", F.lit(0).cast("decimal(22,2)")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), none).cast("decimal(22,2)")
    day = F.to_date("ts") == F.lit("1998-01-05").cast("date")
    return tables.orders(spark, sf_dir).agg(total(paid & day).alias("today"), total(paid & (F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz"))).alias("period"), total(paid).alias("total"), total(F.col("status") == "REFUNDED").alias("refunded"))


@query(f"SELECT plan, count(*) AS orders, sum(amount)::DECIMAL(22,2) AS revenue FROM {ORDERS} WHERE status = 'PAID' GROUP BY plan ORDER BY revenue DESC")
def revenue_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_key(tables.orders(spark, sf_dir).where("status = 'PAID'"), "plan", orders=F.count("*"), revenue=F.sum("amount").cast("decimal(22,2)")).orderBy(F.desc("revenue"))


@query(f"WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(amount) AS r, count(*) AS n FROM {ORDERS} WHERE status = 'PAID' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, month(s.day) || '/' || day(s.day) AS label, coalesce(r, 0)::DECIMAL(22,2) AS revenue, coalesce(n, 0) AS orders FROM s LEFT JOIN d USING (day)")
def revenue_daily_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_filled(tables.orders(spark, sf_dir).where("status = 'PAID'"), "1998-01-01", "1998-03-31", revenue=F.sum("amount").cast("decimal(22,2)"), orders=F.count("*"))


@query(f"SELECT t.tier, count(u.id) AS n FROM (VALUES ('FREE'), ('PLUS'), ('PRO'), ('ULTRA'), ('TEAM')) t(tier) LEFT JOIN {USERS} u ON u.tier = t.tier GROUP BY t.tier")
def users_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_tiers(reports.by_key(tables.users(spark, sf_dir), "tier", n=F.count("*")), ["FREE", "PLUS", "PRO", "ULTRA", "TEAM"])


@query(f"SELECT count(*) AS total, count(*) FILTER (tier <> 'FREE') AS paid, round(100.0 * count(*) FILTER (tier <> 'FREE') / count(*), 2) AS conversion_pct FROM {USERS}")
def users_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversion(tables.users(spark, sf_dir))


@query(f"WITH f AS (SELECT user_id, min(ts) AS ts FROM {ORDERS} GROUP BY user_id), d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM f GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, month(s.day) || '/' || day(s.day) AS label, coalesce(n, 0) AS signups FROM s LEFT JOIN d USING (day)")
def signups_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tables.orders(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("ts"))
    return reports.daily_filled(first, "1995-01-01", "1995-03-31", signups=F.count("*"))


@query(f"SELECT o.id, o.amount, o.plan, o.status, u.name, u.tier FROM (SELECT * FROM {ORDERS} ORDER BY ts DESC, id OFFSET 40 LIMIT 20) o JOIN {USERS} u ON o.user_id = u.id")
def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.page(tables.orders(spark, sf_dir), 3, 20, F.desc("ts"), F.col("id"))
    users = tables.users(spark, sf_dir).select(F.col("id").alias("user_id"), "name", "tier")
    return rows.join(users, "user_id").select("id", "amount", "plan", "status", "name", "tier")


@query(f"SELECT id, user_id, amount, ts FROM {ORDERS} WHERE status = 'REFUNDED' ORDER BY ts DESC, id LIMIT 20")
def orders_page_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page(tables.orders(spark, sf_dir).where("status = 'REFUNDED'"), 1, 20, F.desc("ts"), F.col("id")).select("id", "user_id", "amount", "ts")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE contains(c_name, '77') OR contains(c_mktsegment, 'HOUSE') ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def users_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = c.where(F.col("c_name").contains("77") | F.col("c_mktsegment").contains("HOUSE"))
    return reports.page(found, 1, 25, F.desc("c_acctbal"), F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query(f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM {ORDERS} WHERE status = 'PAID'")
def pagination_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.envelope(tables.orders(spark, sf_dir).where("status = 'PAID'"), 20)


@query(f"SELECT u.id, count(e.id) AS uses FROM {USERS} u LEFT JOIN {USAGE} e ON e.user_id = u.id GROUP BY u.id")
def user_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.usage_log(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("uses"))
    return tables.users(spark, sf_dir).select("id").join(counts, "id", "left").select("id", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))


@query(f"SELECT u.id, count(e.id) AS uses, max(e.ts) AS last_use FROM {USERS} u LEFT JOIN {USAGE} e ON e.user_id = u.id GROUP BY u.id ORDER BY last_use DESC NULLS LAST, u.id LIMIT 10")
def user_usage_left_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = tables.usage_log(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))
    joined = tables.users(spark, sf_dir).select("id").join(uses, "id", "left")
    return joined.select("id", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), "last_use").orderBy(F.desc_nulls_last("last_use"), "id").limit(10)


@query(f"SELECT u.id, EXISTS (SELECT 1 FROM {USAGE} e WHERE e.user_id = u.id AND e.action = 'error') AS banned FROM {USERS} u")
def banned_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    banned = tables.usage_log(spark, sf_dir).where("action = 'error'").select(F.col("user_id").alias("id")).distinct().withColumn("b", F.lit(True))
    return tables.users(spark, sf_dir).select("id").join(banned, "id", "left").select("id", F.col("b").isNotNull().alias("banned"))


@query(f"SELECT e.id, e.user_id, e.action FROM {USAGE} e WHERE e.user_id IN (SELECT id FROM {USERS} WHERE tier = 'PRO')")
def usage_of_page_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tables.users(spark, sf_dir).where("tier = 'PRO'").select(F.col("id").alias("user_id"))
    return tables.usage_log(spark, sf_dir).join(chosen, "user_id", "left_semi").select("id", "user_id", "action")


@query(f"SELECT status, count(*) AS n FROM {ORDERS} GROUP BY status")
def consistency_status_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_key(tables.orders(spark, sf_dir), "status", n=F.count("*"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')")
def consistency_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.where(~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "HOUSEHOLD")).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))


@query(f"SELECT DISTINCT plan FROM {ORDERS}")
def distinct_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("plan").distinct()


@query(f"SELECT count(*) AS n, round(coalesce(sum(tokens), 0), 2) AS tokens FROM (SELECT * FROM {USAGE} ORDER BY ts DESC, id LIMIT 200) WHERE ts >= TIMESTAMP '2024-01-01'")
def mtd_usage_last200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_to_date(tables.usage_log(spark, sf_dir), TODAY, 200)


@query(f"SELECT count(*) AS n, round(coalesce(sum(tokens), 0), 2) AS tokens FROM {USAGE} WHERE ts >= TIMESTAMP '2024-01-01'")
def mtd_usage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_to_date(tables.usage_log(spark, sf_dir), TODAY)


def with_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose anchor is their last order's day, with the period's start."""
    last = tables.orders(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("anchor"))
    users = tables.users(spark, sf_dir).select("id", "tier").join(last, "id", "left")
    return users.withColumn("period_start", billing.period_start(F.add_months(F.to_date("anchor"), 269), F.lit(TODAY).cast("date")))


@query(f"WITH u AS (SELECT u.id, u.tier, CAST(max(o.ts) AS DATE) AS anchor FROM {USERS} u LEFT JOIN {ORDERS} o ON o.user_id = u.id GROUP BY ALL), e AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '1970-01-01') AS n FROM {USAGE} WHERE action = 'view' GROUP BY 1) SELECT u.id, u.tier, CASE WHEN u.tier = 'FREE' THEN coalesce(e.n, 0) END AS used_free FROM u LEFT JOIN e ON e.user_id = u.id WHERE u.tier = 'FREE'")
def quota_free_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = billing.quota(with_periods(spark, sf_dir), tables.usage_log(spark, sf_dir), "view")
    return found.where("tier = 'FREE'").select("id", "tier", F.col("used").alias("used_free"))


def quota_period_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.quota(with_periods(spark, sf_dir), tables.usage_log(spark, sf_dir), "view")


QUERIES["quota_period_usage"] = quota_period_usage


@query(f"SELECT u.id, u.tier, greatest(0, CASE u.tier WHEN 'FREE' THEN 3 WHEN 'PLUS' THEN 50 WHEN 'PRO' THEN 200 ELSE 1000 END - count(e.id)) AS remaining FROM {USERS} u LEFT JOIN (SELECT * FROM {USAGE} WHERE action = 'view' AND ts >= TIMESTAMP '2024-01-01') e ON e.user_id = u.id GROUP BY u.id, u.tier")
def quota_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir).select("id", "tier").withColumn("period_start", billing.period_start(F.lit(None).cast("date"), F.lit(TODAY).cast("date")))
    return billing.quota(users, tables.usage_log(spark, sf_dir), "view").select("id", "tier", "remaining")


@query(f"WITH o AS (SELECT id, user_id, ts + INTERVAL 29 YEAR AS ts FROM {ORDERS} WHERE status = 'PAID') SELECT o.id, count(e.id) AS later_uses, count(e.id) = 0 AS refundable FROM o LEFT JOIN {USAGE} e ON e.user_id = o.user_id AND e.ts >= o.ts AND e.action = 'view' GROUP BY o.id")
def refund_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.orders(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("interval 29 years"))
    return billing.refundable(o, tables.usage_log(spark, sf_dir), "view")


@query(f"SELECT o.id, abs(o.amount::DOUBLE - round(o.amount::DOUBLE + (CASE WHEN o.id % 3 = 0 THEN 0.05 ELSE 0 END), 2)) < 0.01 AND o.id % 2 = 0 AS matched FROM {ORDERS} o")
def notify_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.orders(spark, sf_dir)
    off = F.round(F.col("amount").cast("double") + F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.0), 2)
    notices = o.select(F.col("id").alias("order_id"), off.alias("amount"), F.when(F.col("id") % 2 == 0, "SUCCESS").otherwise("NOTPAY").alias("state"))
    return billing.notified(o, notices)


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'PENDING' ELSE 'REFUNDED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'alipay' WHEN 1 THEN 'wechat' ELSE 'unknown' END AS channel, CASE o_orderkey % 4 WHEN 0 THEN 'TRADE_SUCCESS' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'CLOSED' ELSE 'TRADE_CLOSED' END AS state, TIMESTAMP '2001-08-01' - to_minutes(o_orderkey % 3000) AS ts FROM orders)
SELECT id, status, CASE WHEN status = 'PENDING' AND ts > TIMESTAMP '2001-07-31' AND ts < TIMESTAMP '2001-07-31 23:55:00' AND ((channel = 'alipay' AND state = 'TRADE_SUCCESS') OR (channel = 'wechat' AND state = 'SUCCESS')) THEN 'PAID' WHEN status = 'PENDING' AND ts > TIMESTAMP '2001-07-31' AND ts < TIMESTAMP '2001-07-31 23:55:00' AND ((channel = 'alipay' AND state = 'TRADE_CLOSED') OR (channel = 'wechat' AND state = 'CLOSED')) THEN 'EXPIRED' WHEN status = 'PENDING' AND ts < TIMESTAMP '2001-07-31' THEN 'EXPIRED' ELSE status END AS new_status FROM o""")
def reconcile_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.orders(spark, sf_dir)
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("id") % n + 1).cast("int"))
    minutes = F.make_dt_interval(mins=(F.col("id") % 3000).cast("int"))
    o = o.select("id", "status", pick(3, "alipay", "wechat", "unknown").alias("channel"), pick(4, "TRADE_SUCCESS", "SUCCESS", "CLOSED", "TRADE_CLOSED").alias("gateway_state"), (F.lit(NOW).cast("timestamp_ntz") - minutes).alias("ts"))
    return billing.reconciled(o, NOW)


@query(f"SELECT id, CASE WHEN status = 'PENDING' AND ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'EXPIRED' ELSE status END AS status FROM {ORDERS}")
def expire_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.expire(tables.orders(spark, sf_dir), NOW).select("id", "status")


@query(f"SELECT id, CAST(greatest(CAST(ts AS DATE), DATE '2000-01-01') + CAST(30 AS INTEGER) AS DATE) AS end_day FROM {ORDERS}")
def renew_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("id", billing.renewed(F.to_date("ts"), F.lit("2000-01-01").cast("date"), 30).alias("end_day"))


@query(f"WITH u AS (SELECT id, tier, TIMESTAMP '{TODAY}' + to_hours(id * 7 % 240) AS end_ts, id % 5 <> 0 AS mail FROM {USERS}) SELECT id, CAST(ceil((epoch(end_ts) - epoch(TIMESTAMP '{TODAY}')) / 86400.0) AS BIGINT) AS days_left FROM u WHERE tier <> 'FREE' AND mail AND end_ts BETWEEN TIMESTAMP '{TODAY}' AND TIMESTAMP '{TODAY}' + INTERVAL 8 DAY AND ceil((epoch(end_ts) - epoch(TIMESTAMP '{TODAY}')) / 86400.0) IN (7, 3, 1)")
def reminder_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.make_dt_interval(hours=(F.col("id") * 7 % 240).cast("int"))
    users = tables.users(spark, sf_dir).select("id", "tier", (F.lit(TODAY).cast("timestamp_ntz") + hours).alias("end_ts"), F.when(F.col("id") % 5 != 0, "mail").alias("email"))
    return billing.reminders(users, TODAY)


@query(f"WITH f AS (SELECT 5000 / avg(tokens) FILTER (tokens > 0) AS f FROM {USAGE}) SELECT count(*) AS n, count(*) FILTER (abs(t - tokens * f) <= 0.5000001) AS near FROM (SELECT tokens, f, CASE WHEN tokens > 0 THEN round(tokens * f) ELSE tokens END AS t FROM {USAGE}, f)")
def token_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.usage_log(spark, sf_dir).withColumn("old", F.col("tokens"))
    new = billing.rescaled(log, 5000.0)
    mean = log.agg(F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("mean"))  # one row
    near = F.abs(F.col("tokens") - F.col("old") * (F.lit(5000.0) / F.col("mean"))) <= 0.5000001
    return new.join(F.broadcast(mean)).agg(F.count("*").alias("n"), F.count(F.when(near, 1)).alias("near"))


@query(f"SELECT id, action, ts FROM {USAGE} WHERE NOT coalesce(ts < TIMESTAMP '2024-01-15' AND action NOT IN ('purchase', 'signup'), false)")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.retained(tables.usage_log(spark, sf_dir), ["purchase", "signup"], "2024-01-15").select("id", "action", "ts")


@query("SELECT action, old_rows, kept_rows, old_rows - kept_rows AS deleted FROM (SELECT event_type AS action, count(*) AS old_rows, count(*) FILTER (NOT (ts < TIMESTAMP '2024-01-15' AND event_type NOT IN ('purchase', 'signup'))) AS kept_rows FROM events GROUP BY 1)")
def retention_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.usage_log(spark, sf_dir)
    gone = F.coalesce((F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) & ~F.col("action").isin("purchase", "signup"), F.lit(False))
    return log.groupBy("action").agg(F.count("*").alias("old_rows"), F.count(F.when(~gone, 1)).alias("kept_rows")).withColumn("deleted", F.col("old_rows") - F.col("kept_rows"))


@query(f"SELECT id, CASE tier WHEN 'ULTRA' THEN 'TEAM' WHEN 'PLUS' THEN 'BASIC' ELSE tier END AS tier FROM {USERS}")
def tier_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.remapped(tables.users(spark, sf_dir), "tier", {"ULTRA": "TEAM", "PLUS": "BASIC"}).select("id", "tier")


@query("SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value FROM (SELECT r_regionkey AS key, r_name AS value FROM region) o FULL JOIN (SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey < 8 AND n_nationkey % 2 = 0) n ON o.key = n.key")
def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    new = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 8 and n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return billing.upserted(old, new, "key")


@query(f"SELECT id, user_id FROM {ORDERS} WHERE user_id NOT IN (SELECT id FROM {USERS} WHERE tier = 'PLUS')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = tables.users(spark, sf_dir).where("tier = 'PLUS'")
    return billing.cascaded(tables.orders(spark, sf_dir), gone, "user_id").select("id", "user_id")


@query(f"SELECT id, CASE WHEN starts_with(k, 'APP_') THEN 'alipay' WHEN starts_with(k, 'WX_') THEN 'wechat' WHEN starts_with(k, 'QR_') THEN 'qrcode' ELSE 'unknown' END AS channel FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'APP_' WHEN 1 THEN 'WX_' WHEN 2 THEN 'QR_' ELSE 'X_' END || id AS k FROM {ORDERS})")
def classify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("APP_", "WX_", "QR_", "X_"))), (F.col("id") % 4 + 1).cast("int"))
    return tables.orders(spark, sf_dir).select("id", billing.channel(F.concat(prefix, F.col("id").cast("string"))).alias("channel"))


@query(f"SELECT id, plan, CASE WHEN contains(lower(plan), 'ultra') OR contains(plan, 'URGENT') THEN 'ULTRA' WHEN contains(lower(plan), 'pro') THEN 'PRO' ELSE 'PLUS' END AS tier FROM {ORDERS}")
def plan_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.regexp_replace("plan", "URGENT", "ULTRA")
    return tables.orders(spark, sf_dir).select("id", "plan", billing.tier_of_plan(named).alias("tier"))


@query(f"SELECT id, CASE WHEN tier <> 'FREE' AND end_day < DATE '{TODAY}' THEN 'FREE' ELSE tier END AS tier, CASE WHEN tier <> 'FREE' AND end_day < DATE '{TODAY}' THEN NULL ELSE end_day END AS end_day FROM (SELECT id, tier, CAST(DATE '2024-01-01' + CAST(id % 60 AS INTEGER) AS DATE) AS end_day FROM {USERS})")
def lazy_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir).withColumn("end_day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    return billing.lapsed(users, TODAY)


@query(f"SELECT id, CASE WHEN status = 'PAID' AND id % 3 = 0 AND id % 2 = 0 THEN 'REFUNDED' ELSE status END AS new_status, status = 'PAID' AND id % 3 = 0 AND id % 2 = 0 AS downgrade FROM {ORDERS}")
def refund_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.orders(spark, sf_dir).withColumns({"requested": F.col("id") % 3 == 0, "succeeded": F.col("id") % 2 == 0})
    return billing.refunds(o)


@query(f"""SELECT id, CASE WHEN won AND id % 2 = 0 THEN 'REFUNDED' ELSE status END AS status, CASE WHEN won THEN 2 ELSE 0 END AS winners, CASE WHEN won THEN ['PAID->REFUNDING', CASE WHEN id % 2 = 0 THEN 'REFUNDING->REFUNDED' ELSE 'REFUNDING->PAID' END] ELSE [] END AS audit
FROM (SELECT id, status, status = 'PAID' AND id % 3 = 0 AS won FROM {ORDERS})""")
def settle_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds asked for twice at once, of which one wins, and then done or rolled back by the gateway's answer."""
    o = tables.orders(spark, sf_dir).select("id", "status")
    answer = "named_struct('at', 2, 'expected', 'REFUNDING', 'new', if(id % 2 = 0, 'REFUNDED', 'PAID'))"
    asked = "named_struct('at', 1, 'expected', 'PAID', 'new', 'REFUNDING')"
    tries = o.where("id % 3 = 0").selectExpr("id AS order_id", f"explode(array({answer}, {asked}, {asked})) AS t").select("order_id", "t.*")
    return billing.settled(o, tries)


@query(f"SELECT u.id, CASE WHEN p.user_id IS NULL THEN u.tier ELSE 'PLUS' END AS tier, CASE WHEN p.user_id IS NULL THEN NULL ELSE CAST(DATE '{NOW}' + CAST(30 * p.n AS INTEGER) AS DATE) END AS end_day, CASE WHEN p.user_id IS NULL THEN NULL ELSE DATE '{NOW}' END AS quota_start FROM {USERS} u LEFT JOIN (SELECT user_id, count(*) AS n FROM {ORDERS} WHERE status = 'PAID' GROUP BY 1) p ON p.user_id = u.id")
def apply_paid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir).withColumn("end_day", F.lit(None).cast("date"))
    return billing.applied(users, tables.orders(spark, sf_dir).withColumn("days", F.lit(30)), NOW)


@query(f"SELECT id FROM {USERS} UNION SELECT user_id FROM {USAGE}")
def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.usage_log(spark, sf_dir).select(F.col("user_id").alias("id"))
    return billing.found_or_created(tables.users(spark, sf_dir), asked, "id")


@query(f"SELECT user_id, action, id AS last_id, ts FROM {USAGE} QUALIFY row_number() OVER (PARTITION BY user_id, action ORDER BY ts DESC, id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("id", "ts"), F.struct("ts", "id")).alias("x")
    return tables.usage_log(spark, sf_dir).groupBy("user_id", "action").agg(best).select("user_id", "action", F.col("x.id").alias("last_id"), "x.ts")


@query(f"SELECT id, user_id, ts FROM {ORDERS} WHERE status = 'PENDING' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, id) = 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("ts", "id")).alias("x")
    return tables.orders(spark, sf_dir).where("status = 'PENDING'").groupBy("user_id").agg(first).select("x.id", "user_id", "x.ts")


@query("SELECT map_from_entries(list({'k': r_name, 'v': CAST(r_regionkey AS VARCHAR)} ORDER BY r_name))['ASIA'] AS asia, count(*) AS n FROM region")
def config_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("r_name", F.col("r_regionkey").cast("string")))))  # a small configuration table
    return r.agg(pairs.alias("m"), F.count("*").alias("n")).select(F.col("m")["ASIA"].alias("asia"), "n")


@query(f"SELECT action, CAST(ts AS DATE) AS day, count(*) AS n, sum(count(*)) OVER (PARTITION BY action ORDER BY CAST(ts AS DATE))::BIGINT AS so_far FROM {USAGE} GROUP BY 1, 2")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.usage_log(spark, sf_dir).groupBy("action", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("so_far", F.sum("n").over(Window.partitionBy("action").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))

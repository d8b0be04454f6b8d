"""Billing rules: quota periods, reconciliation, refunds, renewals and table mutations as transforms.

Plain Parquet has no conditional update, so each mutation returns the table's new state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents a period, by tier; plan amounts and days.
LIMITS = {"FREE": 3, "PLUS": 50, "PRO": 200, "ULTRA": 1000}


def lookup(key: Column, table: dict[str, int], default: int) -> Column:
    """A small fixed table as an expression."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def tier_of_plan(plan: Column) -> Column:
    """ULTRA or PRO if the plan's name holds it, in that order, else PLUS."""
    low = F.lower(plan)
    return F.when(low.contains("ultra"), "ULTRA").when(low.contains("pro"), "PRO").otherwise("PLUS")


#: Order id prefixes of the payment channels; an installation passes its own.
PREFIXES = {"APP_": "alipay", "WX_": "wechat", "QR_": "qrcode"}


def channel(order_id: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The payment channel that an order id's prefix tells."""
    return F.coalesce(*(F.when(order_id.startswith(p), c) for p, c in prefixes.items()), F.lit("unknown"))


def period_start(anchor: Column, now: Column) -> Column:
    """The start of the current period: the anchor moved on by clamped months while the next start isn't past ``now``.

    Each move clamps the day again, so an anchor on the 31st stays on the 28th after
    February; add_months from the anchor would not. Without an anchor: the first of the month.
    """
    months = F.sequence(F.lit(1), F.lit(200))
    moved = F.aggregate(months, anchor.cast("date"), lambda at, _: F.when(F.add_months(at, 1) <= now.cast("date"), F.add_months(at, 1)).otherwise(at))
    return F.when(anchor.isNull(), F.trunc(now.cast("date"), "month")).otherwise(moved)


def quota(users: DataFrame, log: DataFrame, action: str) -> DataFrame:
    """(id, tier, used, allowed, remaining): FREE counts for life, other tiers since the period's start.

    ``users`` has id, tier and period_start. The log is filtered and joined once; counts are made per user.
    """
    hits = log.where(F.col("action") == action).select(F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
    joined = users.join(hits, "id", "left").where(F.col("day").isNull() | (F.col("tier") == "FREE") | (F.col("day") >= F.col("period_start")))
    used = joined.groupBy("id").agg(F.count("day").alias("used"))
    allowed = lookup(F.col("tier"), LIMITS, 50).cast("long")
    return users.join(used, "id", "left").select("id", "tier", F.coalesce("used", F.lit(0)).cast("long").alias("used"), allowed.alias("allowed")).withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("allowed") - F.col("used")))


def refundable(orders: DataFrame, log: DataFrame, action: str) -> DataFrame:
    """(id, later_uses, refundable): a paid order may be refunded if its user did nothing at or after its time.

    Orders and uses are dealt once, by user and day: within a day a window counts,
    and later days come from running totals of a user's days, so that a user of
    very many rows isn't one task's.
    """
    day = F.to_date("ts").alias("day")
    paid = orders.where("status = 'PAID'").select(F.col("user_id").alias("of"), day, "ts", "id", F.lit(0).alias("used"))
    uses = log.where((F.col("action") == action) & F.col("ts").isNotNull() & F.col("user_id").isNotNull()).select(F.col("user_id").alias("of"), day, "ts", F.lit(None).cast(paid.schema["id"].dataType).alias("id"), F.lit(1).alias("used"))
    rows = paid.union(uses).repartition("of", "day")
    since = Window.partitionBy("of", "day").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("of").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("of", "day").agg(F.sum("used").alias("n")).select("of", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"))
    counted = rows.withColumn("same", F.sum("used").over(since)).where("id is not null").join(days, ["of", "day"], "left")
    total = (F.coalesce("after", F.lit(0)) + F.col("same")).cast("long")
    return counted.select("id", total.alias("later_uses")).withColumn("refundable", F.col("later_uses") == 0)


def reconciled(orders: DataFrame, now: str) -> DataFrame:
    """(id, status, new_status): pending orders by the gateway's state and their age.

    ``orders`` has channel and gateway_state. Between 5 minutes and a day of age the gateway decides; older ones expire.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    inside = (F.col("ts") > moment - F.expr("interval 24 hours")) & (F.col("ts") < moment - F.expr("interval 5 minutes"))
    paid = ((F.col("channel") == "alipay") & F.col("gateway_state").isin("TRADE_SUCCESS", "TRADE_FINISHED")) | ((F.col("channel") == "wechat") & (F.col("gateway_state") == "SUCCESS"))
    closed = ((F.col("channel") == "alipay") & (F.col("gateway_state") == "TRADE_CLOSED")) | ((F.col("channel") == "wechat") & F.col("gateway_state").isin("CLOSED", "PAYERROR", "REVOKED"))
    old = F.col("ts") < moment - F.expr("interval 24 hours")
    pending = F.col("status") == "PENDING"
    new = F.when(pending & inside & paid, "PAID").when(pending & inside & closed, "EXPIRED").when(pending & old, "EXPIRED").otherwise(F.col("status"))
    return orders.select("id", "status", new.alias("new_status"))


def expire(orders: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """The orders with pending ones older than ``hours`` expired."""
    old = (F.col("status") == "PENDING") & (F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))
    return orders.withColumn("status", F.when(old, "EXPIRED").otherwise(F.col("status")))


def renewed(end: Column, now: Column, days: Column | int) -> Column:
    """The later of end and now, moved on by days."""
    return F.date_add(F.greatest(F.coalesce(end, now), now), days)


def reminders(users: DataFrame, now: str, days: tuple[int, ...] = (7, 3, 1)) -> DataFrame:
    """(id, days_left): paying users with an address whose end is within 8 days, at the given days only."""
    moment = F.lit(now).cast("timestamp_ntz")
    left = F.ceil((F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))) / 86400).cast("long")
    due = users.where((F.col("tier") != "FREE") & F.col("email").isNotNull() & F.col("end_ts").between(moment, moment + F.expr("interval 8 days")))
    return due.select("id", left.alias("days_left")).where(F.col("days_left").isin(*days))


def notified(orders: DataFrame, notices: DataFrame) -> DataFrame:
    """(id, matched): whether a notice agrees with its order in amount (to a cent) and state."""
    n = notices.select(F.col("order_id").alias("id"), F.col("amount").alias("paid"), "state")
    agree = (F.abs(F.col("amount").cast("double") - F.col("paid").cast("double")) < 0.01) & F.col("state").isin("TRADE_SUCCESS", "SUCCESS")
    return orders.join(n, "id").select("id", F.coalesce(agree, F.lit(False)).alias("matched"))


def rescaled(log: DataFrame, real_average: float) -> DataFrame:
    """The log with positive tokens scaled so that their average becomes the real one."""
    factor = F.lit(real_average) / F.avg(F.when(F.col("tokens") > 0, F.col("tokens")))
    one = log.agg(F.coalesce(factor, F.lit(1.0)).alias("__factor"))  # one row
    scaled = F.when(F.col("tokens") > 0, F.round(F.col("tokens") * F.col("__factor"))).otherwise(F.col("tokens"))
    return log.join(F.broadcast(one)).withColumn("tokens", scaled).drop("__factor")


def retained(log: DataFrame, keep: list[str], cutoff: str) -> DataFrame:
    """The log without rows that are old and of no kind to keep; rows with nulls stay."""
    gone = (F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")) & ~F.col("action").isin(*keep)
    return log.where(~F.coalesce(gone, F.lit(False)))


def remapped(df: DataFrame, column: str, new: dict[str, str]) -> DataFrame:
    """A column with some values replaced."""
    out = reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), list(new.items())[1:], F.when(F.col(column) == next(iter(new)), next(iter(new.values()))))
    return df.withColumn(column, out.otherwise(F.col(column)))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both tables, the new ones where both have a key."""
    cols = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    picked = [F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *picked)


def cascaded(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A child table without the rows of removed parents."""
    return child.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def found_or_created(old: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The old rows and a new one for each key that they lack."""
    return old.select(key).union(asked.select(key).distinct().join(old.select(key), key, "left_anti"))


def applied(users: DataFrame, orders: DataFrame, now: str) -> DataFrame:
    """(id, tier, end_day, quota_start): users after their paid orders; a later order counts on from an earlier one's end.

    Days of all of a user's new orders add up, and the tier is that of the latest one.
    """
    paid = orders.where("status = 'PAID'").groupBy("user_id").agg(F.sum("days").cast("int").alias("days"), F.max_by("plan", F.struct("ts", "id")).alias("plan"))
    today = F.lit(now).cast("date")
    joined = users.join(paid, users.id == paid.user_id, "left")
    end = F.when(F.col("days").isNotNull(), renewed(F.col("end_day"), today, F.col("days"))).otherwise(F.col("end_day"))
    return joined.select("id", F.when(F.col("plan").isNotNull(), tier_of_plan(F.col("plan"))).otherwise(F.col("tier")).alias("tier"), end.alias("end_day"), F.when(F.col("days").isNotNull(), today).alias("quota_start"))


def refunds(orders: DataFrame) -> DataFrame:
    """(id, new_status, downgrade): the end of a refund by the gateway's answer (column ``succeeded``); others stay as they are."""
    asked = (F.col("status") == "PAID") & F.col("requested")
    new = F.when(asked & F.col("succeeded"), "REFUNDED").otherwise(F.col("status"))
    return orders.select("id", new.alias("new_status"), (asked & F.col("succeeded")).alias("downgrade"))


def lapsed(users: DataFrame, now: str) -> DataFrame:
    """Users with lapsed subscriptions set back to FREE without an end."""
    over = (F.col("tier") != "FREE") & (F.col("end_day") < F.lit(now).cast("date"))
    return users.select("id", F.when(over, "FREE").otherwise(F.col("tier")).alias("tier"), F.when(over, None).otherwise(F.col("end_day")).alias("end_day"))


def settled(orders: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, status, winners, audit): orders after attempts (order_id, at, expected, new) to change their status, in order of time.

    An attempt wins if the status is what it expects at its turn, as a
    compare-and-set would have it; ``audit`` lists the changes, and ``winners`` is their
    number. Of attempts of one time the smaller status comes first; nulls lose.
    """
    listed = attempts.where("order_id is not null and new is not null").groupBy(F.col("order_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("at", "new", "expected"))).alias("tries"))  # one order's attempts
    begin = F.struct(F.col("status").alias("status"), F.array().cast("array<string>").alias("audit"))

    def turn(state: Column, t: Column) -> Column:
        wins = F.coalesce(state["status"] == t["expected"], F.lit(False))
        line = F.concat(state["status"], F.lit("->"), t["new"])
        return F.struct(F.when(wins, t["new"]).otherwise(state["status"]).alias("status"), F.when(wins, F.concat(state["audit"], F.array(line))).otherwise(state["audit"]).alias("audit"))

    rows = orders.select("id", "status").join(listed, "id", "left").withColumn("end", F.aggregate(F.coalesce("tries", F.array().cast(listed.schema["tries"].dataType)), begin, turn))
    return rows.select("id", F.col("end.status").alias("status"), F.size("end.audit").cast("long").alias("winners"), F.col("end.audit").alias("audit"))

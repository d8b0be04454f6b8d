"""Usage, revenue and user reports: one pass of conditional aggregates, date spines and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_totals(log: DataFrame, today: str) -> DataFrame:
    """Tokens and rows of one day and of all time, in one pass; sums of nothing are 0."""
    now = F.to_date("ts") == F.lit(today).cast("date")
    return log.agg(
        F.count(F.when(now, 1)).alias("today_count"),
        F.round(F.coalesce(F.sum(F.when(now, F.col("tokens"))), F.lit(0.0)), 2).alias("today_tokens"),
        F.count("*").alias("total_count"),
        F.round(F.coalesce(F.sum("tokens"), F.lit(0.0)), 2).alias("total_tokens"),
    )


def spine(df: DataFrame, first: str, last: str) -> DataFrame:
    """(day): every day of a span, without reading ``df``."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.sparkSession.range(1).select(F.explode(days).alias("day"))


def daily_filled(df: DataFrame, first: str, last: str, **sums: Column) -> DataFrame:
    """(day, label, sums): an aggregate for each day of the span; days without rows have 0.

    The filter on the span reaches the scan, and the aggregate is small before it meets the spine.
    """
    inside = (F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    daily = df.where(inside).groupBy(F.to_date("ts").alias("day")).agg(*(c.alias(n) for n, c in sums.items()))
    label = F.concat(F.month("day"), F.lit("/"), F.dayofmonth("day"))
    return spine(df, first, last).join(daily, "day", "left").select("day", label.alias("label"), *(F.coalesce(F.col(n), F.lit(0).cast(daily.schema[n].dataType)).alias(n) for n in sums))


def by_key(df: DataFrame, key: str, **sums: Column) -> DataFrame:
    """An aggregate for each value of a column."""
    return df.groupBy(key).agg(*(c.alias(n) for n, c in sums.items()))


def newest(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The latest rows, ties by id: a top-k report."""
    return df.orderBy(F.col("ts").desc(), F.col("id")).limit(n).select(*cols or df.columns)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of an ordered listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def envelope(df: DataFrame, size: int) -> DataFrame:
    """(total, total_pages) of a listing."""
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def with_tiers(counts: DataFrame, tiers: list[str]) -> DataFrame:
    """Counts by tier with every tier present."""
    every = counts.sparkSession.createDataFrame([(t,) for t in tiers], "tier string")
    return every.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def conversion(users: DataFrame) -> DataFrame:
    """Users, paying users and their percentage, 0 if there are none."""
    total, paid = F.count("*"), F.count(F.when(F.col("tier") != "FREE", 1))
    return users.agg(total.alias("total"), paid.alias("paid")).select("total", "paid", F.when(F.col("total") > 0, F.round(100 * F.col("paid") / F.col("total"), 2)).otherwise(0.0).alias("conversion_pct"))


def month_to_date(log: DataFrame, now: str, last: int | None = None) -> DataFrame:
    """Rows and tokens of the month of ``now``; with ``last``, of the newest rows alone, as a client that holds no more would count."""
    rows = log.orderBy(F.col("ts").desc(), F.col("id")).limit(last) if last else log
    start = F.lit(now[:8] + "01").cast("timestamp_ntz")
    return rows.where(F.col("ts") >= start).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("tokens"), F.lit(0.0)), 2).alias("tokens"))


def lookup(df: DataFrame, **equal: object) -> DataFrame:
    """The rows whose columns have given values (null meets null); equality reaches the scan of the table."""
    for name, value in equal.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df

"""Adapters that read the supplied tables as the library's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order states by the status letter of the supplied table.
STATES = {"F": "PAID", "O": "PENDING", "P": "REFUNDED"}
#: Tiers by market segment.
TIERS = {"AUTOMOBILE": "FREE", "BUILDING": "PLUS", "FURNITURE": "PRO", "HOUSEHOLD": "ULTRA", "MACHINERY": "FREE"}


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, action, preset, tokens, ts) from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("preset"), F.col("value").alias("tokens"), "ts")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, amount, plan, status, ts) from orders; amounts as decimals."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderpriority").alias("plan"), status.alias("status"), F.col("o_orderdate").alias("ts"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, tier, balance) from customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tier = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("c_mktsegment")), F.lit("FREE"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), tier.alias("tier"), F.col("c_acctbal").alias("balance"))

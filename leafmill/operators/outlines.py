"""Outlines: rows of (key, pos, level, title) by expressions, grouping and ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.rules import trimmed


def skeleton(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node, level, number, title, norm): headings one level down, numbered in order; blank titles and levels below 1 are dropped."""
    title = trimmed("title")
    order = Window.partitionBy(key).orderBy("pos")
    kept = rows.where((F.col("level") >= 1) & (title != "")).withColumn("node", F.concat(F.lit("sk"), (F.row_number().over(order) - 1).cast("string")))
    level = F.least(F.floor(F.col("level") + 0.5), F.lit(6)).cast("int")
    own = kept.select(key, "node", F.least(level + 1, F.lit(6)).alias("level"), trimmed(F.coalesce("number", F.lit(""))).alias("number"), title.alias("title"), tx.heading_norm(F.col("title")).alias("norm"))
    return own.where("norm != ''")


def skeleton_arrays(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, nodes): one array of (id, level, number, norm) a document, in order."""
    at = F.substring("node", 3, 10).cast("int")
    own = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct(F.col("node").alias("id"), "level", "number", "norm").alias("node"))))
    return nodes.groupBy(key).agg(F.transform(own, lambda x: x["node"]).alias("nodes"))


def outline_totals(nodes: DataFrame, key: str = "doc_id", share: float = 0.7) -> DataFrame:
    """(key, chapters, keeps_numbers): chapters without front and back matter; whether so many headings have numbers that they are kept."""
    matter = tx.is_front_matter(F.col("title")) | tx.is_back_matter(F.col("title"))
    chapters = F.count_if((F.col("level") == 2) & ~matter)
    return nodes.groupBy(key).agg(chapters.alias("chapters"), (F.avg((F.col("number") != "").cast("int")) >= share).alias("keeps_numbers"))


def single_title(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, level, title): the first heading of level 1 is the title; its repetitions go, others of level 1 become level 2."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(F.col("level") == 1, tx.heading_key(F.col("title"))), ignorenulls=True).over(so_far)
    known = rows.withColumn("first", first)
    later = (F.col("level") == 1) & F.col("first").isNotNull()
    again = later & (F.col("first") != "") & (F.col("first") == tx.heading_key(F.col("title")))
    return known.where(~again).select(key, "pos", F.when(later, 2).otherwise(F.col("level")).alias("level"), "title")


def last_headings(rows: DataFrame, key: str = "doc_id", n: int = 5) -> DataFrame:
    """(key, headings): the last ``n`` titles, joined in order."""
    back = Window.partitionBy(key).orderBy(F.desc("pos"))
    last = rows.withColumn("r", F.row_number().over(back)).where(F.col("r") <= n)
    own = F.array_sort(F.collect_list(F.struct("pos", trimmed("title").alias("t"))))
    return last.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["t"]), " -> ").alias("headings"))


def heading_levels(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, level, number): what a title, in small letters and trimmed, had last."""
    last = F.max_by(F.struct("level", F.coalesce("number", F.lit("")).alias("number")), "pos")
    found = rows.groupBy(key, F.lower(trimmed("title")).alias("title")).agg(last.alias("x"))
    return found.select(key, "title", "x.level", "x.number")

"""Document structure: headings, counts, numbers, paths and captions, by expressions and ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"


def headings(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, level, title): a row for each heading, in order."""
    levels, titles = F.regexp_extract_all(html, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(html, F.lit(HEADING), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(levels.alias("level"), titles.alias("title"))).alias("pos", "h"))
    return rows.select(key, "pos", F.col("h.level").cast("int").alias("level"), tx.plain(F.col("h.title")).alias("title"))


def counts(html: Column) -> list[Column]:
    """The structural counts of HTML: paragraphs, headings, list items, images, tables, characters."""
    n = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    return [
        n(r"(?i)<p\b").alias("paragraphs"),
        (n(r"(?i)<h[1-6]\b[^>]*>") - n(r"(?i)<h[1-6]\b[^>]*doc-title[^>]*>")).alias("headings"),
        F.greatest(n(r"(?i)<li\b"), n(r"[(（]\s*[0-9]+\s*[)）]")).alias("items"),
        (n(r"(?i)<img\b") + n("__IMG_[0-9]+__")).alias("images"),
        n(r"(?i)<table\b").alias("tables"),
        F.length(tx.compact(html)).cast("long").alias("chars"),
    ]


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the lines of texts that hold more than white space."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "")


def counters(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` (key, pos, level 1 to 3) with c1, c2, c3: counters that begin anew below a higher heading.

    The three windows nest, so one shuffle by the key serves all.
    """
    so_far = lambda *by: Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda n: F.count(F.when(F.col("level") == n, 1))
    one = rows.withColumn("c1", at(1).over(so_far(key)))
    two = one.withColumn("c2", at(2).over(so_far(key, "c1")))
    return two.withColumn("c3", at(3).over(so_far(key, "c1", "c2")))


def heading_numbers(rows: DataFrame, scheme: str = "decimal", key: str = "doc_id") -> DataFrame:
    """(key, pos, level, number): empty below a chapter that has not begun."""
    counted = counters(rows, key)
    own = F.slice(F.array("c1", "c2", "c3"), 1, F.col("level"))
    number = F.when((F.col("level") > 1) & (F.col("c1") == 0), "").otherwise(tx.numbered(own, scheme))
    return counted.select(key, "pos", "level", number.alias("number"))


def heading_paths(rows: DataFrame, key: str = "doc_id", depth: int = 140) -> DataFrame:
    """(key, pos, path): the headings that stand above each one, and itself."""
    counted = counters(rows, key)
    title = lambda n: F.when(F.col("level") == n, F.substring("line", 1, depth))
    last = lambda n, *by: F.last(title(n), ignorenulls=True).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.select(key, "pos", last(1, key).alias("t1"), last(2, key, "c1").alias("t2"), last(3, key, "c1", "c2").alias("t3"))
    return found.select(key, "pos", F.concat_ws(" > ", "t1", "t2", "t3").alias("path"))


def caption_numbers(rows: DataFrame, relative: bool, key: str = "doc_id") -> DataFrame:
    """(key, pos, kind, number): captions (``kind`` not null) in order, all over or by chapter (rows of level 1)."""
    chapter = F.count(F.when(F.col("level") == 1, 1)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("chapter", chapter).where(F.col("kind").isNotNull())
    n = F.row_number().over(Window.partitionBy(key, "kind", *(["chapter"] if relative else [])).orderBy("pos")).cast("string")
    number = F.when(F.col("chapter") > 0, F.concat_ws("-", F.col("chapter").cast("string"), n)).otherwise(n) if relative else n
    return found.select(key, "pos", "kind", number.alias("number"))


def shifted(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, level): levels moved up so that each document's least is 1."""
    least = rows.groupBy(key).agg(F.min("level").alias("least"))
    return rows.join(least, key).select(key, "pos", (F.col("level") - F.col("least") + 1).alias("level"))


def repeated_neighbours(rows: DataFrame, least: int = 30, key: str = "doc_id") -> DataFrame:
    """(key, pos): lines equal to the one before."""
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("before", before).where((F.col("line") == F.col("before")) & (F.length("line") >= least)).select(key, "pos")


def number_regressions(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, n, before): numbers (column n) not above the last one seen."""
    before = F.last("n", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.col("n") <= F.col("before")).select(key, "pos", "n", "before")


def runs(rows: DataFrame, test: Column, least: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, first, length): stretches of rows that pass a test, by gaps and islands."""
    order = Window.partitionBy(key).orderBy("pos")
    numbered = rows.withColumn("yes", F.coalesce(test, F.lit(False))).withColumn("r", F.row_number().over(order))
    islands = numbered.where("yes").withColumn("island", F.col("r") - F.row_number().over(order))
    return islands.groupBy(key, "island").agg(F.min("pos").alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).select(key, "first", "length")

"""Readers and writers of files: whole texts, images, results, listings, streams of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Megabytes of a file, by tier.
FILE_LIMITS = {"FREE": 100, "PLUS": 200, "PRO": 200, "ULTRA": 500}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, size): the files whose names match; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size")).where(F.col("name").rlike(pattern))


def images(spark: SparkSession, path: str, most: int = 20 << 20) -> DataFrame:
    """(path, url): image files up to a size as data URLs; the size is tested before the content is read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    mime = F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").when(kind == "svg", "svg+xml").otherwise(kind))
    return files.select("path", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("url"))


def image_kind(content: Column) -> Column:
    """The kind of an image by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 44))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("D7CDC69A"), "wmf").when(F.substring(head, 81, 8) == "20454D46", "emf")


def admitted(files: DataFrame) -> DataFrame:
    """The files (name, size, tier) that their tier allows; old binary documents are refused."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FILE_LIMITS.items() for x in kv)), F.col("tier")), F.lit(100))
    return files.where(~F.lower("name").endswith(".doc") & (F.col("size") <= limit.cast("long") * (1 << 20)))


def results(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of JSON files, one file each, with or without a byte order mark; broken ones are dropped."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("body"))
    clean = F.regexp_replace("body", r"^\x{FEFF}", "")
    return raw.select(F.from_json(clean, schema).alias("r")).where("r is not null").select("r.*")


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Append rows to a Parquet folder."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def copied(df: DataFrame, dates: list[str], default: str) -> DataFrame:
    """A table with its text dates as timestamps; what is no date becomes the default."""
    return df.withColumns({c: F.coalesce(F.try_to_timestamp(c), F.lit(default).cast("timestamp")) for c in dates})

"""Shared helpers of the corpus operators: staging, cleaning up, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts can be long, so a batch stays far under Spark's default of 10,000 rows.
BATCH_ROWS = 1024
#: Rows that are sent to every executor; beyond this count they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: While a table is staged: shuffle files go as soon as it is written, since nothing reads them again.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def prepare(spark: SparkSession) -> None:
    """Bound the size of Arrow batches unless the session has set its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the session
    runs on one machine (tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@cache
def local_dir(application: str) -> str:
    """A temporary folder for a session on one machine: the same one each time it is asked for."""
    return f"file://{tempfile.mkdtemp(prefix='leafmill-')}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (table, its path).

    This cuts the lineage, so that a lost executor costs a re-read and never
    a second run of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}/{name}"
    with settings(spark, CLEANUP):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A staged table of short rows, marked for broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= most else df


def unstage(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` for work that looks at one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_pydict(out)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all training: crc32 of its id as text has remainder 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
